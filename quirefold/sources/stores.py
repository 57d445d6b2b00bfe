"""File stores that executors open by URL: local paths, HDFS, S3, GCS, ABFS."""

from __future__ import annotations

from pyarrow import fs


def opened(url: str) -> tuple[fs.FileSystem, str]:
    """The store of a Hadoop-style URL, and the path in it; a path without scheme is local."""
    if "://" not in url:
        return fs.LocalFileSystem(), url.removeprefix("file:")
    return fs.FileSystem.from_uri(url.replace("s3a://", "s3://", 1))


def put(store: fs.FileSystem, path: str, content: bytes, mark: str) -> None:
    """Writes a file under a name of its own and moves it into place, so that no reader sees half of it."""
    folder, _, name = path.rpartition("/")
    draft = f"{folder}/.{name}.{mark}"
    with store.open_output_stream(draft) as out:
        out.write(content)
    store.move(draft, path)
