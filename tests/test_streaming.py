import threading
import time

import pytest
from pyspark.sql import functions as F

from quirefold.streaming import gate, ledger, watch


def put(inbox, **pages):
    inbox.mkdir(exist_ok=True)
    for name, body in pages.items():
        (inbox / name.replace("_", ".")).write_bytes(body)


def upper(contents, kinds):
    if b"bad" in contents:
        raise ValueError("unreadable")
    return [c.decode().upper() for c in contents]


def once(spark, tmp_path, checkpoint="c", per_batch=2, **more):
    pages = watch.arrivals(spark, str(tmp_path / "in"), per_batch).withColumn("kind", F.lit("print"))
    query = watch.watch(pages, upper, str(tmp_path / "out"), str(tmp_path / checkpoint), once=True, delay=0.0, **more)
    query.awaitTermination()


def done(spark, tmp_path):
    rows = watch.results(spark, str(tmp_path / "out")).collect()
    return sorted(r.text for r in rows if not r.failed), sorted(r.path.rsplit("/", 1)[1] for r in rows if r.failed)


def test_watcher(spark, tmp_path):
    put(tmp_path / "in", a_jpg=b"one", b_png=b"bad", c_jpg=b"two", d_txt=b"no image")
    calls = []
    heart = watch.Heartbeat(calls.append, 0.0)
    spark.streams.addListener(heart)
    once(spark, tmp_path, "c1")
    put(tmp_path / "in", e_jpg=b"three")
    once(spark, tmp_path, "c1")
    once(spark, tmp_path, "c2")  # a fresh checkpoint sees all files again; what is done isn't repeated
    spark.streams.removeListener(heart)
    assert done(spark, tmp_path) == (["ONE", "THREE", "TWO"], ["b.png"])
    now, before = (spark.createDataFrame(x, "path string, length long") for x in ([("a", 3), ("b", 4)], [("a", 3), ("b", 2)]))
    assert [r.path for r in watch.stable(now, before).collect()] == ["a"]


def test_sidecars(spark, tmp_path):
    put(tmp_path / "in", a_jpg=b"one", b_jpg=b"two", b_txt=b"done by hand")
    once(spark, tmp_path, sidecars=True)
    assert (tmp_path / "in" / "a.txt").read_text() == "ONE" and (tmp_path / "in" / "b.txt").read_text() == "done by hand"
    assert done(spark, tmp_path) == (["ONE"], [])


@pytest.mark.parametrize("checkpoint", ["c", "another"])
@pytest.mark.parametrize("broken", ["begin", "_create", "move", "write_page_texts", "add", "end"])
def test_a_failure_anywhere_costs_no_page_and_repeats_none(spark, tmp_path, monkeypatch, broken, checkpoint):
    put(tmp_path / "in", a_jpg=b"one", b_png=b"bad", c_jpg=b"two")
    home = {"begin": ledger.Ledger, "_create": ledger.Ledger, "move": ledger, "write_page_texts": watch, "add": watch.Keys, "end": ledger.Ledger}[broken]
    real, calls = getattr(home, broken), []

    def failing(*given, **more):
        calls.append(given)
        if broken == "_create" and "/records/" not in given[1] or broken == "add" and len(calls) == 1:
            return real(*given, **more)
        raise OSError("the store is down")

    with monkeypatch.context() as m:
        m.setattr(home, broken, failing)
        with pytest.raises(Exception, match="the store is down"):
            once(spark, tmp_path, per_batch=10, sidecars=True)
    assert calls
    once(spark, tmp_path, checkpoint, per_batch=10, sidecars=True)
    once(spark, tmp_path, checkpoint, per_batch=10, sidecars=True)
    assert done(spark, tmp_path) == (["ONE", "TWO"], ["b.png"])
    assert sorted(p.name for p in (tmp_path / "in").iterdir() if p.suffix == ".txt") == ["a.txt", "c.txt"]


def test_what_a_failed_attempt_left_is_never_read(spark, tmp_path):
    log = ledger.Ledger(spark, str(tmp_path), "a long")
    rows = lambda *a: spark.createDataFrame([(x,) for x in a], "a long")
    rows(7).write.parquet(f"{tmp_path}/data/batch=q-0/attempt=dead")
    assert log.read().count() == 0 and log.write(rows(1, 2), "q-0") and not log.write(rows(3), "q-0") and log.write(rows(4), "q-1")
    assert sorted(r.a for r in log.read().collect()) == [1, 2, 4] and sorted(r.a for r in log.read("q-0").collect()) == [1, 2]
    log.begin("q-2")
    assert log.unended() == ["q-2"] and not log.committed("q-2")


def test_a_slow_file_passes_when_it_rests(spark, tmp_path):
    put(tmp_path / "in", slow_jpg=b"-", still_jpg=b"whole", gone_jpg=b"x")
    slow, growing = tmp_path / "in" / "slow.jpg", threading.Event()

    def grow():
        while not growing.wait(0.05):
            with slow.open("ab") as out:
                out.write(b"-")

    writer = threading.Thread(target=grow)
    writer.start()
    files = watch.arrivals(spark, str(tmp_path / "in")).withColumn("kind", F.lit("print")).drop("content")
    pages = gate.settled_files(files, 0.5).withColumn("kind", F.lit("print"))
    query = watch.watch(pages, upper, str(tmp_path / "out"), str(tmp_path / "c"), every="200 milliseconds", delay=0.0)
    (tmp_path / "in" / "gone.jpg").unlink()
    try:
        until = time.monotonic() + 120
        while time.monotonic() < until and not done(spark, tmp_path)[0]:
            time.sleep(0.5)
        assert done(spark, tmp_path)[0] == ["WHOLE"]  # the slow one grows all the while
        query.stop()  # state outlives the query
        growing.set()
        writer.join()
        query = watch.watch(pages, upper, str(tmp_path / "out"), str(tmp_path / "c"), every="200 milliseconds", delay=0.0)
        while time.monotonic() < until and len(done(spark, tmp_path)[0]) < 2:
            time.sleep(0.5)
        assert done(spark, tmp_path)[0] == sorted(["WHOLE", slow.read_text()])
    finally:
        growing.set()
        query.stop()


def test_looks(spark):
    now = None
    for size, want in ((5, 0), (5, 1), (6, 0), (6, 1), (6, 2)):
        now = gate.seen(size, now)
        assert now == (size, want)
    assert gate.length_of("/nowhere/at all") is None


def test_slices_share_out_a_kind(spark):
    many = spark.createDataFrame([(str(i), bytearray(b"x"), "print") for i in range(64)], "path string, content binary, kind string")
    shared = watch.transcribed(many, lambda contents, kinds: ["ok"] * len(contents), delay=0.0)
    assert len({r.part for r in shared.select(F.spark_partition_id().alias("part")).collect()}) > 1
