"""The inbox watcher: new images are transcribed once, failures are set aside, restarts repeat nothing that is done.

A batch's results, failures included, are one batch of a ledger, which commits them before anything else is told of them;
the keys of what is done and the texts beside the images follow from the committed rows, and are made up for where a
failure came between. So a failure at any point costs neither a page nor a second row of it.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from quirefold.sources.files import IMAGES, suffix
from quirefold.sources.sinks import beside, write_page_texts
from quirefold.streaming.ledger import Ledger

Transcribe = Callable[[list[bytes], list[str]], list[str]]
RESULTS = "path string, text string, failed boolean"


def arrivals(spark: SparkSession, folder: str, per_batch: int = 4) -> DataFrame:
    """New images below a folder, a few files a trigger. Files must be moved in whole (write elsewhere, then rename); those
    that aren't go through `gate.settled_files` first."""
    read = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    read = read.option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_batch)
    return read.load(folder).where(suffix(F.col("path")).isin(list(IMAGES)))


class Keys:
    """Which paths are done: an empty file each, named by a hash, so that asking costs one look a path, however many there
    are."""

    def __init__(self, spark: SparkSession, folder: str):
        self._path, self._folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, folder.rstrip("/")
        self._store = self._path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, path: str):
        key = hashlib.sha256(path.encode()).hexdigest()
        return self._path(f"{self._folder}/{key[:2]}/{key}")

    def __contains__(self, path: str) -> bool:
        return self._store.exists(self._at(path))

    def add(self, path: str) -> None:
        self._store.create(self._at(path), True).close()


def stable(now: DataFrame, before: DataFrame) -> DataFrame:
    """Of a listing the files whose size an earlier listing also saw: for inboxes that can't rename."""
    return now.join(before.select("path", F.col("length").alias("__was")), "path").where(F.col("length") == F.col("__was")).drop("__was")


def transcribed(pages: DataFrame, transcribe: Transcribe, kind: str = "kind", retries: int = 2, delay: float = 5.0, slices: int = 4) -> DataFrame:
    """path, text, failed: a kind's pages go to `slices` partitions, so that its model is loaded a few times, and a kind that
    nearly all pages are of is still shared out.

    A batch that fails is tried again; after that its pages fail one by one.
    """

    def attempt(contents: list[bytes], kinds: list[str]) -> list[str]:
        for again in range(retries + 1):
            try:
                return transcribe(contents, kinds)
            except Exception:
                if again == retries:
                    raise
                time.sleep(delay)
        return []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                texts: list = attempt(batch["content"].tolist(), batch[kind].tolist())
            except Exception:
                texts = []
                for content, one in zip(batch["content"], batch[kind], strict=True):
                    try:
                        texts += transcribe([content], [one])
                    except Exception:
                        texts.append(None)
            yield pd.DataFrame({"path": batch["path"], "text": pd.Series(texts, dtype=object), "failed": [t is None for t in texts]})

    slice_ = F.pmod(F.xxhash64("path"), F.lit(slices))
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pages.repartition(parts, kind, slice_).mapInPandas(run, "path string, text string, failed boolean")


def results(spark: SparkSession, out: str) -> DataFrame:
    """path, text, failed of every page that is done, and its batch."""
    return Ledger(spark, out, RESULTS).read()


def watch(
    pages: DataFrame, transcribe: Transcribe, out: str, checkpoint: str,
    kind: str = "kind", once: bool = False, every: str = "5 seconds", delay: float = 5.0, sidecars: bool = False,
) -> StreamingQuery:
    """Starts the watcher; `results` reads what it has done, failures too. What is there isn't done again, nor - with
    sidecars - what has a .txt beside it, where each result is then written too.

    Pages without content (of `gate.settled_files`) are read when their batch is due. A trigger asks for its own few paths
    only (`maxFilesPerTrigger`); earlier results are never read.
    """
    spark = pages.sparkSession
    log, known = Ledger(spark, out, RESULTS), Keys(spark, f"{out.rstrip('/')}/keys")

    def finish(name: str) -> None:
        """All that follows from a committed batch; each part can be done again."""
        rows = log.read(name)
        if sidecars:
            write_page_texts(rows.where("NOT failed").withColumn("to", beside(F.col("path"))), name="to")
        for row in rows.select("path").collect():  # a trigger's few paths
            known.add(row.path)
        log.end(name)

    def batch(df: DataFrame, number: int) -> None:
        name = f"{_query_id(spark, checkpoint)}-{number}"
        if not log.committed(name):
            paths = [r.path for r in df.select("path").distinct().collect() if r.path not in known]
            if sidecars:
                paths = [p for p in paths if not _exists(spark, re.sub(r"\.[^./]*$", "", p) + ".txt")]
            if not paths:
                return
            due = df.where(F.col("path").isin(paths)).dropDuplicates(["path"])
            if "content" not in df.columns:
                due = due.join(df.sparkSession.read.format("binaryFile").load(paths).select("path", "content"), "path")
            log.begin(name)
            log.write(transcribed(due, transcribe, kind, delay=delay), name)
        finish(name)

    for name in log.unended():
        finish(name) if log.committed(name) else log.end(name)
    writer = pages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def _query_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a checkpoint gives its query: batch numbers count from nought in each."""
    return json.loads(spark.read.text(f"{checkpoint.rstrip('/')}/metadata").first().value)["id"]


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


class Heartbeat(StreamingQueryListener):
    """Calls back on progress, and on idle triggers no more often than asked."""

    def __init__(self, beat: Callable[[str], None], seconds: float = 60.0):
        self.beat, self.seconds, self._last = beat, seconds, 0.0

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.beat(f"started {event.id}")

    def onQueryProgress(self, event) -> None:  # noqa: N802
        rows = event.progress.numInputRows
        if rows or time.monotonic() - self._last >= self.seconds:
            self._last = time.monotonic()
            self.beat(f"{rows} new" if rows else "waiting")

    def onQueryIdle(self, event) -> None:  # noqa: N802
        if time.monotonic() - self._last >= self.seconds:
            self._last = time.monotonic()
            self.beat("waiting")

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.beat("stopped")


def latest_state(spark: SparkSession, folder: str, schema: str, key: str, order: str, checkpoint: str, table: str) -> DataFrame:
    """Replays a folder of Parquet files as a stream until all is read: key, n (rows) and the last row of each key.

    A batch adds the keys it has changed to a ledger, and no others; the reader takes the newest of each key.
    """
    stream = spark.readStream.schema(schema).parquet(folder)
    rest = [f.name for f in stream.schema if f.name != key]
    last = stream.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max(F.struct(order, *[c for c in rest if c != order])).alias("last"))
    changed = last.select(key, "n", "last.*")
    log = Ledger(spark, table, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in changed.schema))

    def put(df: DataFrame, number: int) -> None:
        log.write(df, f"{_query_id(spark, checkpoint)}-{number}")

    query = changed.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    found = log.read()
    return found.groupBy(key).agg(F.max_by(F.struct(*(c for c in found.columns if c not in (key, "batch"))), "n").alias("row")).select(key, "row.*")
