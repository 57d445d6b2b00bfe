import csv
import io
import tarfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quirefold.sources import archive, files, sinks, tables
from quirefold.streaming import ledger, watch


def test_corpus_csv(spark, tmp_path):
    path = tmp_path / "metadata.csv"
    path.write_text('failinimi,transkriptsioon,allikas\na.jpg,"line ""one""\nline two",src\nb.jpg,short\nc.jpg," padded ",\n', encoding="utf-8")
    rows = {r.failinimi: (r.transkriptsioon, r.allikas) for r in tables.read_corpus(spark, str(path)).collect()}
    assert rows == {"a.jpg": ('line "one"\nline two', "src"), "b.jpg": ("short", None), "c.jpg": (" padded ", None)}


def test_corpus_round_trip_and_replacement(spark, tmp_path):
    rows = [("a", 'x "q", y\n\nz\\', "s"), ("b", " lead", None), ("c", "õ\t1", "t")]
    df = spark.createDataFrame(rows, tables.CORPUS)
    sinks.write_corpus(df, str(tmp_path / "csv"))
    assert sorted(map(tuple, tables.read_corpus(spark, str(tmp_path / "csv")).collect())) == rows
    live = str(tmp_path / "live")
    sinks.replace_with_backup(df, live)
    sinks.replace_with_backup(df.limit(1), live)
    assert spark.read.parquet(live).count() == 1 and spark.read.parquet(live + ".bak").count() == 3
    sinks.append_rows(df.drop("allikas"), str(tmp_path / "all"))
    sinks.append_rows(df, str(tmp_path / "all"))
    found = spark.read.parquet(str(tmp_path / "all"))
    assert found.columns == tables.CORPUS.names and found.where("allikas is null").count() == 4
    assert sinks.save(df, str(tmp_path / "dry"), dry=True).first().rows == 3 and not (tmp_path / "dry").exists()
    pages = df.select(F.col("failinimi").alias("stem"), F.col("transkriptsioon").alias("text")).unionAll(spark.createDataFrame([("d", None)], "stem string, text string"))
    for _ in range(2):  # a rerun writes the same files
        assert sinks.write_page_texts(pages, f"file://{tmp_path}/pages") == 4
    assert {p.name: p.read_text() for p in (tmp_path / "pages").iterdir()} == {"a.txt": rows[0][1], "b.txt": " lead", "c.txt": "õ\t1", "d.txt": ""}


def test_corpus_csv_keeps_nulls_empty_texts_and_any_character(spark, tmp_path):
    texts = [None, "", '"', '""', "\0", '\0"', '"\0', "\0\n", '\\"', '"\\', ",", "a\rb", "\r\n", '\r\n"', "\n", " ", "\ufeff", "null", '",\n"', '"' * 999]
    rows = [(f"{i}", a, b) for i, (a, b) in enumerate((a, b) for a in texts for b in texts)]
    rows += [(None, None, None), ("", "", ""), (None, "", None), ("\0", "\0", "\0")]
    sinks.write_corpus(spark.createDataFrame(rows, tables.CORPUS), str(tmp_path / "csv"))
    found = tables.read_corpus(spark, str(tmp_path / "csv"))
    assert Counter(map(tuple, found.collect())) == Counter(rows) and found.count() == len(rows)
    plain = [row for part in (tmp_path / "csv").glob("*.csv") for row in list(csv.reader(io.StringIO(part.read_bytes().decode(), newline="")))[1:]]
    assert Counter(map(tuple, plain)) == Counter(tuple(x or "" for x in row) for row in rows)  # any reader's CSV


def test_a_failed_replacement_leaves_the_live_table(spark, tmp_path, monkeypatch):
    df, live, real = spark.range(3), str(tmp_path / "live"), sinks.move
    sinks.replace_with_backup(df, live)
    sinks.replace_with_backup(df.limit(2), live)

    def failing(session, old, new):
        if old.endswith(".tmp"):
            raise OSError("refused")
        return real(session, old, new)

    monkeypatch.setattr(sinks, "move", failing)
    with pytest.raises(OSError):
        sinks.replace_with_backup(df.limit(1), live)
    assert spark.read.parquet(live).count() == 2
    monkeypatch.undo()
    sinks.replace_with_backup(df.limit(1), live)
    assert spark.read.parquet(live).count() == 1 and spark.read.parquet(live + ".bak").count() == 2


def test_ranges_paths_images(spark):
    assert [r.page for r in tables.number_range(spark, "00098..00101").collect()] == ["00098", "00099", "00100", "00101"] and tables.number_range(spark, "7").first().page == "00007"
    rows = spark.createDataFrame([((bytearray(b"x"), "p"),), ((bytearray(b""), "p"),), (None,)], "image struct<bytes: binary, path: string>")
    assert [r.b is not None for r in rows.select(tables.image_bytes(F.col("image")).alias("b")).collect()] == [True, False, False]
    assert spark.createDataFrame([("a/b/c.jpg",)], "p string").select(tables.relocated(F.col("p"), "new/").alias("p")).first().p == "new/c.jpg"


@pytest.fixture
def tree(tmp_path):
    for name in ("w1/scan_1.jpg", "w1/scan_10.jpg", "w1/scan_2.JPG", "w1/scan_2.txt", "w1/_cover.jpg", "w1/scan_1.json", "_tmp/a.jpg", ".hid/a.jpg", "config/a.jpg", "w2/a.png", "w2/a.tif", "w2/note.md"):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text('{"status":"Valmis"}' if name.endswith("json") else "x")
    (tmp_path / "w2/bad.json").write_text("{oops")
    return tmp_path


def test_directories(spark, tree):
    # Spark's own readers leave out names that begin with a dot or an underscore
    listed = files.listing(spark, str(tree))
    assert sorted(r.name for r in files.work_pages(listed).collect()) == ["scan_1.jpg", "scan_10.jpg", "scan_2.JPG"]
    assert [r.name for r in files.in_natural_order(files.images(listed).where("work = 'w1'")).collect()] == ["scan_1.jpg", "scan_2.JPG", "scan_10.jpg"]
    assert sorted(r.name for r in files.pending(listed).where("work <> 'config'").collect()) == ["a.png", "a.tif", "scan_1.jpg", "scan_10.jpg"]
    documents = {r.path.rsplit("/", 1)[1]: r.readable for r in files.json_documents(spark, str(tree)).collect()}
    assert documents == {"scan_1.json": True, "bad.json": False}


def test_slots_for_documents_and_images(spark):
    docs = spark.createDataFrame([("a.pdf", bytearray(b"xy")), ("b.pdf", bytearray(b"")), ("c.pdf", bytearray(b"!"))], "path string, content binary")

    def render(content):
        if content == b"!":
            raise ValueError("broken")
        return [bytes([c]) for c in content]

    pages = files.expanded(docs, render)
    assert sorted((r.path, r.page, r.image and bytes(r.image), r.failed) for r in pages.collect()) == [("a.pdf", 1, b"x", False), ("a.pdf", 2, b"y", False), ("c.pdf", None, None, True)]
    assert sorted(bytes(r.image) for r in files.reencoded(pages.where("not failed"), lambda b: b * 2).collect()) == [b"xx", b"yy"]


def test_mirror_rules(spark):
    rules = [("leave", "*/tmp/*"), ("take", "*.jpg"), ("leave", "*")]
    paths = ["a/tmp/x.jpg", "a/x.jpg", "a/x.txt"]
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select("p", files.mirror_filter(F.col("p"), rules).alias("t")).collect()
    assert {r.p: r.t for r in rows} == {p: files.mirrored(p, rules) for p in paths} == {"a/tmp/x.jpg": False, "a/x.jpg": True, "a/x.txt": False}


def test_tar_members(spark, tmp_path):
    for k, kind in ((1, "w:gz"), (2, "w")):
        with tarfile.open(tmp_path / f"part{k}.tar{'.gz' if k == 1 else ''}", kind) as tar:
            for name in (f"d/p{k}.xml", f"d/p{k}.JPG", "readme.md"):
                info = tarfile.TarInfo(name)
                info.size = 3
                tar.addfile(info, io.BytesIO(b"abc"))
    archive.register(spark)
    assert spark.read.format("tarmembers").load(f"file://{tmp_path}/part2.tar*").count() == 3
    read = lambda s: spark.read.format("tarmembers").option("suffixes", s).load(str(tmp_path))
    assert sorted(r.stem for r in read(".xml").collect()) == ["p1", "p2"] and sorted(r.stem for r in read(".jpg,.png").collect()) == ["p1", "p2"]
    assert read("").count() == 6 and {bytes(r.content) for r in read(".xml").collect()} == {b"abc"}


def test_retries(spark, tmp_path):
    flag = str(tmp_path / "tried")

    def transcribe(contents, kinds):
        import os

        if not os.path.exists(flag):
            open(flag, "w").close()
            raise OSError("busy")
        return ["ok"] * len(contents)

    df = spark.createDataFrame([("p", bytearray(b"x"), "print")], "path string, content binary, kind string")
    assert watch.transcribed(df, transcribe, delay=0.0).first().text == "ok"


def _archives(folder, names):
    for k, kind in ((1, "w:gz"), (2, "w"), (3, "w")):
        with tarfile.open(folder / f"part{k}.tar{'.gz' if k == 1 else ''}", kind, format=tarfile.PAX_FORMAT if k == 3 else tarfile.GNU_FORMAT) as tar:
            for i, name in enumerate(names(k)):
                info = tarfile.TarInfo(name)
                body = f"{k}-{i}".encode() * (i + 1)
                info.size = len(body)
                tar.addfile(info, io.BytesIO(body))
            folder_ = tarfile.TarInfo("empty/folder")
            folder_.type = tarfile.DIRTYPE
            tar.addfile(folder_)


def test_split_archives_equal_whole_ones(spark, tmp_path):
    _archives(tmp_path, lambda k: [f"d{k}/{'long/' * 30 if i % 9 == 0 else ''}p{i}.{'XML' if i % 2 else 'xml' if i % 3 else 'md'}" for i in range(60)])
    (tmp_path / "empty.tar").write_bytes(b"\0" * 10240)
    archive.register(spark)
    whole = {(r.archive.rsplit("/", 1)[1], r.member): bytes(r.content) for r in spark.read.format("tarmembers").load(str(tmp_path)).collect()}
    index = archive.index(archive.archives_of(spark, str(tmp_path))).cache()
    assert index.count() == len(whole) == 180 and index.where("offset is null").select("archive").distinct().count() == 1
    for split in (512, 1 << 20):
        read = archive.contents(index, split)
        assert {(r.archive.rsplit("/", 1)[1], r.member): bytes(r.content) for r in read.collect()} == whole
    some = archive.contents(index.where(archive.with_suffix(".xml") & (F.col("stem") != "p1")), 2048).collect()
    assert {(r.archive.rsplit("/", 1)[1], r.member) for r in some} == {k for k in whole if k[1].lower().endswith(".xml") and not k[1].endswith("/p1.XML")}
    assert archive.contents(index.where("false")).count() == 0


def test_a_compressed_archive_is_opened_once_for_all_batches(spark, tmp_path, monkeypatch):
    _archives(tmp_path, lambda k: [f"p{i % 55}.xml" for i in range(60)])  # five names are there twice
    asked, opened = {}, []
    index = archive.index(archive.archives_of(spark, f"{tmp_path}/part1.tar.gz"))
    whole, real, members = [bytes(r.content) for r in archive.contents(index).collect()], type(index).mapInArrow, archive._members
    assert sorted(whole) == sorted(f"1-{i}".encode() * (i + 1) for i in range(60))
    monkeypatch.setattr(type(index), "mapInArrow", lambda df, run, schema: asked.update(rows=df, run=run) or real(df, run, schema))
    archive.contents(index.where("stem <> 'p7'").cache())
    monkeypatch.undo()
    monkeypatch.setattr(archive, "_members", lambda path: opened.append(path) or members(path))
    found = [c.as_py() for batch in asked["run"](asked["rows"].toArrow().to_batches(max_chunksize=4)) for c in batch.column("content")]
    assert found == [f"1-{i}".encode() * (i + 1) for i in range(60) if i != 7] and len(opened) == 1


def test_packed_archives_are_as_many_as_the_rows_need(spark, tmp_path):
    rows = {f"d/{i}.xml": f"{i}".encode() * (i % 40) for i in range(300)}
    df = spark.createDataFrame([(n, bytearray(b)) for n, b in rows.items()], "name string, body binary").repartition(3)
    for part, least in ((200, 20), (1 << 20, 6)):
        packed = archive.pack(df, f"file://{tmp_path}/{part}", part).cache()
        paths = [r.path for r in packed.collect()]
        assert len(paths) >= least and {p.endswith(".gz") for p in paths} == {True, False} and (part == 200 or len(paths) == 6)
        alone = archive.each_alone(packed)
        assert alone.rdd.glom().map(len).collect() == [1] * len(paths)
        found = archive.contents(archive.index(alone), 1024).collect()
        assert len(found) == 300 and {r.member: bytes(r.content) for r in found} == rows


def test_filters_reach_the_archive_source(spark, tmp_path):
    _archives(tmp_path, lambda k: ["a/one.xml", "b/two.txt", "b/three.xml"])
    archive.register(spark)
    read = spark.read.format("tarmembers").load(str(tmp_path))
    assert sorted(r.member for r in read.where(F.col("member").endswith(".xml") & F.col("member").startswith("b/")).collect()) == ["b/three.xml"] * 3
    assert [r.content for r in read.where((F.col("stem") == "two") & F.col("archive").endswith("part2.tar")).collect()] == [bytearray(b"2-12-1")]
    assert read.where(F.col("stem").isin("one", "two") & (F.length("content") > 3)).count() == 3
    reader = archive._Reader({"path": str(tmp_path)})
    kept = list(reader.pushFilters([archive.StringEndsWith(("member",), ".xml"), archive.EqualTo(("content",), b""), archive.In(("stem",), ("one",))]))
    assert len(kept) == 1 and reader._wanted(member="x.xml", stem="one") and not reader._wanted(member="x.txt", stem="one")


def test_archives_arrive(spark, tmp_path):
    inbox, out = tmp_path / "in", ledger.Ledger(spark, str(tmp_path / "out"), "archive string, member string, stem string, content binary")
    for run in (1, 2):
        inbox.mkdir(exist_ok=True)
        with tarfile.open(tmp_path / "new.tar", "w") as tar:
            info = tarfile.TarInfo(f"page{run}.xml")
            info.size = 1
            tar.addfile(info, io.BytesIO(b"x"))
        (tmp_path / "new.tar").rename(inbox / f"part{run}.tar")
        (inbox / "note.txt").write_text("no archive")
        put = lambda df, n: out.write(archive.contents(archive.index(df)), str(n))
        archive.arriving(spark, str(inbox)).writeStream.foreachBatch(put).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        assert sorted(r.stem for r in out.read().collect()) == [f"page{k}" for k in range(1, run + 1)]
