"""Queries over whole tables, on rows that their SQL twins were once spared."""

import difflib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quirefold.operators import joins
from quirefold.plans import registry


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        row, last = [i + 1], row
        for j, y in enumerate(b):
            row.append(min(last[j + 1] + 1, row[j] + 1, last[j] + (x != y)))
    return row[-1]


def rate(truth, guess):
    truth, guess = truth.strip(), guess.strip()
    return round(distance(truth, guess) / len(truth) if truth else float(bool(guess)), 9)


TEXTS = ["than the other", "der Pfad zum thé wandert, ß", "  thé et l'an été  ", "".join(map(chr, range(0x4E00, 0x4EA0))) + " than", "\U0001d49c than", "a <b>than</b> é", "an̈ th", "\n"]


@pytest.fixture(scope="module")
def pages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("whole")
    rows = [(i + 1, f"s{i % 2}", t) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{folder}/documents.parquet")
    return str(folder), rows


def changed(text):
    return text.replace("th", "t").replace("an", "en")


def test_cer_of_all_documents_equals_brute_force(spark, pages):
    folder, rows = pages
    queries = registry.queries()
    want = {i: rate(t, changed(t)) if i % 7 else None for i, _, t in rows if t.strip()}
    assert {r.doc_id: r.cer for r in queries["cer_all"](spark, folder).collect()} == want
    for name, key in (("cer_macro_by_source", "source"), ("cer_every_model", "model")):
        for r in queries[name](spark, folder).collect():
            mine = [want[i] for i, s, t in rows if t.strip() and (key == "model" or s == r[key])]
            there = [x for x in mine if x is not None]
            assert (r.pages, r.missing) == (len(there), len(mine) - len(there)) and r.mean_cer == pytest.approx(sum(there) / len(there), abs=1e-8)
    bare = lambda t: t.replace("<b>", "").replace("</b>", "")
    got = {r.doc_id: r.cer for r in queries["tag_stripped_cer"](spark, folder).collect()}
    assert got == {i: rate(bare(t), bare(t.replace("th", "t"))) for i, _, t in rows}


def test_every_model_takes_any_number_of_models(spark):
    truth = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, truth string")
    guesses = spark.range(10_050).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").cast("string").alias("model"), F.lit("a").alias("guess"))
    found = joins.every_model(truth, guesses, "doc_id", F.col("truth"))
    assert {r.status: r["count"] for r in found.groupBy("status").count().collect()} == {"ok": 10_050, "puudub": 10_050}


def test_error_rates_by_role_equal_brute_force(spark, tmp_path):
    rows = [(i, k, ("user", "assistant")[k % 2], t) for i in range(1, 9) for k, t in enumerate(["than the other", " ", "thé et l'an the été", "a b the c"])]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    guessed = lambda t: t.replace(" the ", " ").replace("an", "en")
    for r in registry.queries()["error_rates_by_role"](spark, str(tmp_path)).collect():
        mine = [(i, t) for i, _, role, t in rows if role == r.role and t.strip()]
        there = [t for i, t in mine if i % 7]
        assert (r.pages, r.missing) == (len(there), len(mine) - len(there))
        assert r.mean_wer == pytest.approx(sum(distance(t.split(), guessed(t).split()) / len(t.split()) for t in there) / len(there), abs=1e-8)
        assert r.mean_cer == pytest.approx(sum(rate(t, guessed(t)) for t in there) / len(there), abs=1e-8)


def test_blank_truths_are_dropped(spark):
    truth = spark.createDataFrame([(1, "\n\t"), (2, "\u00a0"), (3, "a"), (4, None)], "doc_id long, truth string")
    guesses = spark.createDataFrame([(1, "m", "x"), (3, "m", "a")], "doc_id long, model string, guess string")
    assert [r.doc_id for r in joins.with_guess(truth, guesses, "doc_id", F.col("truth")).collect()] == [3]
    assert [r.doc_id for r in joins.every_model(truth, guesses, "doc_id", F.col("truth")).collect()] == [3]


def test_unmatched_shares_equal_difflib(spark, pages):
    folder, rows = pages
    found = {r.doc_id: r.unmatched for r in registry.queries()["unmatched_all"](spark, folder).collect()}
    same = {i: sum(b.size for b in difflib.SequenceMatcher(None, changed(t), t).get_matching_blocks()) for i, _, t in rows}
    assert found == {i: pytest.approx(1 - same[i] / max(len(t), 1), abs=1e-8) for i, _, t in rows}


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """Documents whose numbers outgrow the five digits of a file name's counter."""
    folder = tmp_path_factory.mktemp("many")
    spark.range(99_990, 100_030).union(spark.range(1_234_560, 1_234_580)).selectExpr("id AS doc_id", "'s' AS source").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def by_sql(folder, name):
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    return connection.sql(registry.oracle_sql()[name])


def test_name_census_of_long_counters(spark, many):
    found = registry.queries()["name_census"](spark, many).select("origin", "n").collect()
    assert sorted(map(tuple, found)) == sorted(by_sql(many, "name_census").select("origin, n").fetchall())


def test_sources_of_names_with_long_counters(spark, many):
    found = registry.queries()["source_from_name"](spark, many).select("doc_id", "detected", "filled").collect()
    assert sorted(map(tuple, found)) == sorted(by_sql(many, "source_from_name").select("doc_id, detected, filled").fetchall())


def test_sources_equal_the_sql_on_missing_sources_and_any_number(spark, tmp_path):
    numbers = [*range(-60, 60), *range(99_900, 100_100), -(1 << 63), (1 << 63) - 1, None]
    rows = [(i, (None, "", " ", "s")[(i or 0) // 5 % 4]) for i in numbers]
    spark.createDataFrame(rows, "doc_id long, source string").write.parquet(f"{tmp_path}/documents.parquet")
    for name, columns in (("source_from_name", ("doc_id", "detected", "filled")), ("name_census", ("origin", "n"))):
        found = registry.queries()[name](spark, str(tmp_path)).select(*columns).collect()
        assert Counter(map(tuple, found)) == Counter(by_sql(tmp_path, name).select(", ".join(columns)).fetchall())


def test_round_trip_equals_the_sql_on_missing_and_empty_texts(spark, tmp_path):
    texts = [None, "", "a", '\0"', "a\r\nb", '"a"']
    rows = [(i, a, b) for i, (a, b) in enumerate((a, b) for a in texts for b in texts)] + [(None, "", "s"), (None, None, None), (-7, "x", "")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    found = registry.queries()["csv_round_trip"](spark, str(tmp_path)).collect()
    assert Counter(map(tuple, found)) == Counter(by_sql(tmp_path, "csv_round_trip").fetchall())


def test_archive_members_equal_the_sql_on_odd_rows(spark, tmp_path):
    sources = (None, "", "a/b", "%", "+ õ", "..", "none", "x\ny", "l" * 300)
    rows = [(i, (None, "", "õ", "text")[i % 4], sources[i % 9]) for i in range(-50, 150)]
    rows += [(None, "x", "s"), (7, "again", "a/b"), (7, "again", "a/b"), (8, None, "only nulls"), (9, "left out", "only notes")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    found = registry.queries()["archive_members"](spark, str(tmp_path)).collect()
    assert Counter(map(tuple, found)) == Counter(by_sql(tmp_path, "archive_members").fetchall())


def test_stripped_rates_of_one_file_are_dealt_out(spark, tmp_path):
    spark.range(40).selectExpr("id AS doc_id", "'than the other' AS text").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    assert registry.queries()["tag_stripped_cer"](spark, str(tmp_path)).rdd.getNumPartitions() >= 4


def test_arrow_batches_of_queries_are_bounded_by_bytes(spark, tmp_path):
    for name in ("maxBytesPerBatch", "maxRecordsPerBatch"):
        spark.conf.unset(f"spark.sql.execution.arrow.{name}")
    spark.range(100).selectExpr("id AS doc_id", "repeat('a', 100000) AS text").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    rows = F.pandas_udf(lambda texts: texts.map(lambda _: len(texts)), "long")
    found = registry.read(spark, str(tmp_path), "documents").select(rows("text").alias("n")).agg(F.max("n")).first()[0]
    assert found <= 50
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def above_the_function(df):
    """The plan's steps that work on what the function of the rates returns."""
    return df._jdf.queryExecution().executedPlan().toString().split("ArrowEvalPython")[0]


@pytest.mark.parametrize("name", ["cer_all", "cer_macro_by_source"])
def test_nothing_is_trimmed_again_for_a_rate(spark, pages, name):
    assert "regexp_replace" not in above_the_function(registry.queries()[name](spark, pages[0]))
