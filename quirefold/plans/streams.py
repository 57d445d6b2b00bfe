"""Streaming: a replay until all is read, and the watcher over an inbox of files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quirefold.plans.registry import query, read
from quirefold.session import shared_folder
from quirefold.sources.files import suffix
from quirefold.streaming import gate, watch
from quirefold.streaming.ledger import Ledger


@query("SELECT user_id, count(*) AS n, max(event_id) AS event_id FROM events GROUP BY user_id")
def replay_events(spark, sf_dir):
    """The events as a stream of files, kept as the latest event of each user: equals the batch aggregate."""
    root = f"{shared_folder(spark)}/replay-{uuid.uuid4().hex}"
    read(spark, sf_dir, "events").select("user_id", "event_id").repartition(4, "event_id").write.parquet(f"{root}/in")
    return watch.latest_state(spark, f"{root}/in", "user_id long, event_id long", "user_id", "event_id", f"{root}/checkpoint", f"{root}/state")


@query("""
WITH p AS (SELECT source, count(*) AS n, replace(source, 'src', '')::INT % 5 = 0 AS failed FROM documents GROUP BY source)
SELECT source, CASE WHEN NOT failed THEN n::VARCHAR || ' lines' END AS text, failed FROM p
""")
def watched_inbox(spark, sf_dir):
    """An inbox with one page a source, a line a document; every fifth source can't be read. Run twice, nothing repeats."""
    root = f"{shared_folder(spark)}/inbox-{uuid.uuid4().hex}"
    lines = read(spark, sf_dir, "documents").select("source", F.concat_ws(":", F.col("doc_id"), "lang").alias("value"))
    lines.repartition("source").write.partitionBy("source").text(f"{root}/pages")
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    files = files.option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 8).load(f"{root}/pages")
    number = F.regexp_extract("path", r"source=src(\d+)", 1).cast("int")
    arrived = files.where(suffix(F.col("path")) == ".txt").withColumn("kind", F.when(number % 5 == 0, "hand").otherwise("print"))

    def transcribe(contents, kinds):
        if "hand" in kinds:
            raise ValueError("unreadable page")
        return [f"{len(c.decode().splitlines())} lines" for c in contents]

    for run in (1, 2):
        watch.watch(arrived, transcribe, f"{root}/done", f"{root}/checkpoint-{run}", once=True, delay=0.0).awaitTermination()
    source = F.regexp_extract("path", r"source=(src\d+)", 1).alias("source")
    return watch.results(spark, f"{root}/done").select(source, "text", "failed")


@query("""
WITH s AS (SELECT user_id, event_id, floor(value / 40)::BIGINT AS size, lag(floor(value / 40)) OVER w AS one, lag(floor(value / 40), 2) OVER w AS two
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id AS key, min(event_id) AS at, arg_min(size, event_id) AS size FROM s WHERE size = one AND size = two GROUP BY user_id
""")
def settled_sizes(spark, sf_dir):
    """Every user a file, whose events are looks at its size: the first look that finds it as the two before did. The events
    arrive in four slices, and state carries each user from one run to the next."""
    root = f"{shared_folder(spark)}/looks-{uuid.uuid4().hex}"
    looks = read(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("at"), F.floor(F.col("value") / 40).alias("size"))
    low, high = looks.agg(F.min("at"), F.max("at")).first()
    log = Ledger(spark, f"{root}/out", "key long, at long, size long")
    for k in range(4):
        slice_ = F.floor((F.col("at") - F.lit(low)) * 4 / (F.lit(high) - F.lit(low) + 1)) == k
        looks.where(slice_).write.mode("append").parquet(f"{root}/in")
        out = gate.settled_sightings(spark.readStream.schema(looks.schema).parquet(f"{root}/in"))
        add = out.writeStream.foreachBatch(lambda df, n: log.write(df, str(n))).option("checkpointLocation", f"{root}/checkpoint")
        add.trigger(availableNow=True).start().awaitTermination()
    return log.read().drop("batch")
