"""Members of .tar and .tar.gz archives.

`index` lists what archives hold (a task an archive, headers only where an archive isn't compressed), as a table to filter, keep
and join; `contents` reads the members that are left, dealt out by size: a plain archive is read by many tasks, each at its
members' offsets, a compressed one by one task, once, from its start to the last member asked for. `contents` counts the index
first: keep it as a table (`written`) where archives are large. `arriving` gives new archives of a folder as a stream, and `pack`
makes archives of rows.

spark.read.format("tarmembers").option("suffixes", ".xml").load(path) reads members directly, a partition an archive. Filters
on archive, member or stem are taken before a member is read.

Any store that executors can open by URL. Memory follows the largest member.
"""

from __future__ import annotations

import fnmatch
import io
import itertools
import os
import tarfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyarrow.fs import FileSelector, FileType
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringEndsWith, StringStartsWith

from quirefold.sources.stores import opened

#: Bytes that a task reads of a plain archive, about; bytes of members that a batch holds.
SPLIT, BATCH = 64 << 20, 8 << 20
#: Bytes of members after which `pack` begins another archive; its level of compression (9, tarfile's own, takes five times as
#: long for archives a tenth smaller).
PART, LEVEL = 64 << 20, 1
_INDEX = "archive string, member string, stem string, offset long, size long, place long"


def listed(path: str) -> list[str]:
    """The archives of a folder, or those that a pattern in it names."""
    store, at = opened(path)
    if store.get_file_info(at).type == FileType.Directory:
        found, pattern = store.get_file_info(FileSelector(at)), "*.tar*"
    else:
        folder, _, pattern = at.rpartition("/")
        found = store.get_file_info(FileSelector(folder, allow_not_found=True))
    root = path[: len(path) - len(at)] if path.endswith(at) else ""
    return [root + name for name in sorted(f.path for f in found if f.type == FileType.File and fnmatch.fnmatch(f.base_name, pattern))]


def _stem(member: str) -> str:
    return os.path.splitext(member.rsplit("/", 1)[-1])[0]


def _members(path: str) -> Iterator[tuple[tarfile.TarFile, tarfile.TarInfo, bool]]:
    """An archive, its members, and whether it is plain: then only headers are read until a member is asked for."""
    store, at = opened(path)
    with store.open_input_file(at) as probe:
        plain = probe.size() >= 262 and probe.read_at(5, 257) == b"ustar"
    if plain:
        with store.open_input_file(at) as file, tarfile.open(fileobj=file, mode="r:") as archive:
            for member in archive:
                archive.members = []  # or it would keep them all
                yield archive, member, True
    else:
        with store.open_input_stream(at, compression=None) as raw, tarfile.open(fileobj=raw, mode="r|*") as archive:
            for member in archive:
                archive.members = []
                yield archive, member, False


def index(archives: DataFrame, path: str = "path") -> DataFrame:
    """archive, member, stem, offset (null where the archive is compressed), size and place in the archive of the files in
    archives; rows of paths."""

    def run(batches):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = []
                for place, (_, member, plain) in enumerate(_members(name)):
                    if member.isfile():
                        rows.append((name, member.name, _stem(member.name), member.offset_data if plain else None, member.size, place))
                    if len(rows) >= 10_000:
                        yield _batch(rows)
                        rows = []
                yield _batch(rows)

    def _batch(rows):
        columns = list(zip(*rows, strict=True)) or [()] * 6
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["archive", "member", "stem", "offset", "size", "place"])

    return archives.select(path).mapInArrow(run, _INDEX)


def archives_of(spark: SparkSession, path: str) -> DataFrame:
    """The paths of a folder's archives, each a task of its own."""
    return each_alone(spark.createDataFrame([(n,) for n in listed(path)], "path string"))


def each_alone(paths: DataFrame) -> DataFrame:
    """Rows of paths, each a task of its own: the paths are numbered for that, in one task, which sees nothing but them."""
    place = F.row_number().over(Window.orderBy("path"))
    return paths.select("path", place.alias("place")).repartitionById(max(1, paths.count()), "place").select("path")


def pack(members: DataFrame, folder: str, part: int = PART) -> DataFrame:
    """Packs rows of name and body into archives in a folder, and gives their paths. A task fills two at a time in turn, a
    plain one and a compressed one, and begins another where one holds `part` bytes.

    Write the paths and read archives from that table: an attempt that failed leaves archives that are none of them.
    """

    def run(batches):
        task, numbers, full = TaskContext.get(), itertools.count(), []
        store, at = opened(folder)
        store.create_dir(at, recursive=True)
        open_: dict[str, tuple] = {}

        def end(kind):
            name, raw, tar, _ = open_.pop(kind)
            tar.close()
            raw.close()
            full.append(f"{folder}/{name}")

        kinds = itertools.cycle(("", ".gz"))
        for batch in batches:
            for (name, body), kind in zip(zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True), kinds):
                if kind not in open_:
                    file = f"part-{task.partitionId()}-{task.taskAttemptId()}-{next(numbers)}.tar{kind}"
                    raw = store.open_output_stream(f"{at}/{file}", compression=None)
                    open_[kind] = (file, raw, tarfile.open(fileobj=raw, mode="w|gz", compresslevel=LEVEL) if kind else tarfile.open(fileobj=raw, mode="w|"), [0])
                _, _, tar, held = open_[kind]
                info = tarfile.TarInfo(name)
                info.size = len(body)
                tar.addfile(info, io.BytesIO(body))
                tar.members = []  # or it would keep them all
                held[0] += len(body)
                if held[0] >= part:
                    end(kind)
        for kind in list(open_):
            end(kind)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.string())], ["path"])

    return members.select("name", "body").mapInArrow(run, "path string")


def contents(members: DataFrame, split: int = SPLIT) -> DataFrame:
    """archive, member, stem, content of rows of an index, of which any may have been left out."""

    def run(batches):
        rows = (row for batch in batches for row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True))
        out, size = [], 0
        for archive, asked in itertools.groupby(rows, lambda row: row[0]):  # an archive is opened once, however many batches ask for it
            for row in _read(archive, asked):
                out.append(row)
                size += len(row[3])
                if size > BATCH:
                    yield _rows(out)
                    out, size = [], 0
        yield _rows(out)

    def _rows(rows):
        columns = list(zip(*rows, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.string(), pa.binary()), strict=True)], ["archive", "member", "stem", "content"])

    # members that lie together are read together; a compressed archive is one piece
    piece = F.when(F.col("offset").isNull(), F.lit(-1)).otherwise(F.floor(F.col("offset") / split))
    parts = max(1, members.select("archive", piece.alias("piece")).distinct().count())
    dealt = members.withColumn("piece", piece).repartition(parts, "archive", "piece").sortWithinPartitions("archive", "place")
    return dealt.select("archive", "member", "stem", "offset", "size", "place").mapInArrow(run, "archive string, member string, stem string, content binary")


def _read(archive: str, rows: Iterator[tuple]) -> Iterator[tuple[str, str, str, bytes]]:
    """Rows of one archive, in the order of their places; a compressed archive is gone through along with them."""
    first = next(rows)
    rows = itertools.chain([first], rows)
    if first[3] is not None:
        store, at = opened(archive)
        with store.open_input_file(at) as file:
            for _, member, stem, offset, size, _ in rows:
                yield archive, member, stem, file.read_at(size, offset)
    else:
        there, found, content = enumerate(_members(archive)), -1, b""
        for _, member, stem, _, _, place in rows:
            if found < place:
                while found < place:
                    found, (tar, info, _) = next(there)
                content = tar.extractfile(info).read()
            yield archive, member, stem, content


def with_suffix(*suffixes: str) -> Column:
    """Whether a member's name ends in one of them, whatever its case."""
    return F.lower("member").rlike("(" + "|".join(s.lower().replace(".", r"\.") for s in suffixes) + ")$")


def arriving(spark: SparkSession, folder: str, per_batch: int = 16) -> DataFrame:
    """path of new archives below a folder, a few a trigger; only their names are read. Archives must be moved in whole."""
    read = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    read = read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.tar*").option("maxFilesPerTrigger", per_batch)
    return read.load(folder).select("path")


class TarMembers(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tarmembers"

    def schema(self) -> str:
        return "archive string, member string, stem string, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Archive(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.suffixes = tuple(s.strip().lower() for s in options.get("suffixes", "").split(",") if s.strip())
        self.asked: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Takes what tells members apart by name; Spark keeps the rest."""
        kinds = {EqualTo: "is", In: "in", StringEndsWith: "ends", StringStartsWith: "starts"}
        for one in filters:
            if type(one) in kinds and len(one.attribute) == 1 and one.attribute[0] in ("archive", "member", "stem"):
                self.asked.append((one.attribute[0], kinds[type(one)], one.value))
            else:
                yield one

    def _wanted(self, **names: str) -> bool:
        tests: dict[str, Callable[[str, object], bool]] = {"is": lambda x, v: x == v, "in": lambda x, v: x in v, "ends": lambda x, v: x.endswith(v), "starts": lambda x, v: x.startswith(v)}
        return all(tests[kind](names[name], value) for name, kind, value in self.asked if name in names)

    def partitions(self) -> list[_Archive]:
        return [_Archive(name) for name in listed(self.path) if self._wanted(archive=name)]

    def read(self, partition: _Archive) -> Iterator[tuple]:
        for archive, member, _ in _members(partition.path):
            stem = _stem(member.name)
            if member.isfile() and (not self.suffixes or member.name.lower().endswith(self.suffixes)) and self._wanted(member=member.name, stem=stem):
                yield partition.path, member.name, stem, archive.extractfile(member).read()


def register(spark: SparkSession) -> None:
    """Registers the format, and lets Spark offer filters to sources in Python, which this one needs."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TarMembers)
