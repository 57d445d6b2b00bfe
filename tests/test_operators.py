import json
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirefold.functions import markup
from quirefold.operators import joins, ladder, provenance, reports, samples, sampling, timejoins
from quirefold.operators.quantiles import quantiles
from quirefold.tables import fresh, row_digest


@pytest.mark.parametrize(
    ("name", "want"),
    [
        ("images/00000_083605_0307_3473452.jpg", "kurrent_xix"),
        ("00007_bergskollegium_a__p.jpg", "bergskollegium_adv_seg"),
        ("00007_bergskollegium_rel.jpg", "bergskollegium_rel_seg"),
        ("00007_bergskollegium_x.jpg", "bergskollegium_seg"),
        ("00007_senatsp_x.jpg", "tundmatu"),
        ("jonk_1.jpg", "jonkopings_seg"),
        ("kurrent_xix_08.jpg", "tundmatu"),
    ],
)
def test_source_of(spark, name, want):
    assert spark.createDataFrame([(name,)], "n string").select(provenance.source_of(F.col("n")).alias("s")).first().s == want


def test_filled_and_canonical_source(spark):
    rows = spark.createDataFrame([("x", "hanse_1.jpg"), ("", "hanse_1.jpg"), (None, "hanse_1.jpg"), ("krigshovrattens_dombocker_seg", "a.jpg")], "s string, n string")
    got = rows.select(provenance.canonical_source(provenance.filled_source(F.col("s"), F.col("n"))).alias("x")).collect()
    assert [r.x for r in got] == ["x", "hanse_kurrent_xvi", "hanse_kurrent_xvi", "krigshovrattens_seg"]


def test_material_and_status(spark):
    cases = [
        ({"type": {"id": "Q1261026"}}, "print"), ({"type": {"id": "Q87167", "label": "printed"}}, "hand"), ({"type": {"label": "Manuscript"}}, "hand"), ({"type": "Trükis"}, "print"),
        ({"type": None}, "unknown"), ({}, "unknown"), ("{bad", "unknown"), (None, "unknown"), ({"type": {"label": None}}, "unknown"), ({"type": "printed manuscript"}, "hand"), ({"type": []}, "unknown"),
    ]
    rows = spark.createDataFrame([(i, c if c is None or isinstance(c, str) else json.dumps(c)) for i, (c, _) in enumerate(cases)], "i int, m string")
    assert [r.x for r in rows.orderBy("i").select(provenance.material_of(F.col("m")).alias("x")).collect()] == [w for _, w in cases]
    docs = spark.createDataFrame([(0, '{"status":"Valmis"}'), (1, "{}"), (2, "{bad"), (3, None)], "i int, m string").orderBy("i")
    assert [r.x for r in docs.select(provenance.page_status(F.col("m")).alias("x")).collect()] == ["Valmis", "", None, None]
    keep = lambda m, *a: spark.range(1).select(provenance.wanted_material(F.lit(m), *a).alias("k")).first().k
    assert [keep("hand", "all"), keep("hand"), keep("unknown"), keep("unknown", "print", True)] == [True, False, False, True]


def test_ladder_gives_one_reason_each(spark):
    pages = spark.createDataFrame(
        [("a", None, None, None), ("b", "{}", "Pooleli", "t"), ("c", "{}", "Valmis", None), ("d", "{}", "Valmis", "  "), ("e", "{}", "Valmis", "t"), ("f", "{}", "Valmis", "<m></m>"), ("g", "{}", "Valmis", "t")],
        "page string, doc string, status string, text string",
    )
    kept = F.col("page") != "e"
    judged = pages.withColumn("reason", ladder.reason(ladder.page_tests(F.col("doc"), F.col("status"), F.col("text"), kept, markup.cleaned(F.col("text"))["text"])))
    assert {r.page: r.reason for r in judged.collect()} == dict(a="no_json", b="status", c="no_txt", d="empty", e="wrong_type", f="empty", g="ok")
    assert judged.transform(ladder.census).agg(F.sum("n")).first()[0] == 7
    assert pages.agg(ladder.changed(F.col("text"), F.trim("text"))).first()[0] == 1


def sequential(rows, cap, target):
    taken, counts, full = [], {}, 0
    for project, i, ok in rows:
        if len(taken) >= target:
            break
        if counts.get(project, 0) >= cap:
            full += 1
        elif ok:
            counts[project] = counts.get(project, 0) + 1
            taken.append(i)
    return taken, full


def test_caps_equal_a_sequential_scan(spark):
    rng = random.Random(3)
    rows = [(rng.choice("AABC"), i, rng.random() < 0.7) for i in range(120)]
    df = spark.createDataFrame(rows, "project string, i int, ok boolean").repartition(5)
    taken, full = sequential(rows, 6, 10**9)
    assert sorted(r.i for r in sampling.project_capped(df.where("ok"), "project", "i", 6).collect()) == taken
    assert sampling.project_full(df, "project", "i", F.col("ok"), 6).count() == full
    assert sorted(r.i for r in sampling.project_capped(df.where("ok"), "project", "i", 6, 9).collect()) == sequential(rows, 6, 9)[0]
    assert sorted(r.i for r in sampling.project_capped(spark.createDataFrame([("A", i, i not in (0, 2)) for i in range(5)], df.schema).where("ok"), "project", "i", 2).collect()) == [1, 3]


def test_balanced_is_seeded(spark):
    df = spark.createDataFrame([(i, "x" if i < 50 else "y") for i in range(53)], "id long, source string")
    pick = lambda seed, parts: {r.id for r in sampling.balanced(df.repartition(parts), "source", "id", 5, seed).collect()}
    assert pick(42, 1) == pick(42, 7) != pick(43, 1) and len(pick(42, 1)) == 8 and {50, 51, 52} <= pick(1, 2)
    assert [r.id for r in sampling.shuffled(df, "id").collect()] != list(range(53))


def test_numbers_and_batches(spark):
    df = spark.range(0, 300, 3).withColumnRenamed("id", "k").repartition(6)
    assert [(r.k, r.counter) for r in sampling.numbered(df, "k", start=7).orderBy("k").collect()] == [(3 * i, 7 + i) for i in range(100)]
    assert sampling.numbered(df.limit(0), "k").count() == 0
    assert [r["count"] for r in sampling.batched(df, "k", 30).groupBy("batch").count().orderBy("batch").collect()] == [30, 30, 30, 10]


def test_numbers_are_each_there_once(spark):
    df = spark.range(300_000).select(F.xxhash64("id").alias("k"), F.md5(F.col("id").cast("string")).alias("pay"), F.lit(1).alias("__place"), F.lit("x").alias("__tie"))
    for rows in (df, df.withColumn("k", F.pmod("k", F.lit(3)))):  # as good as unique, and three values that share all rows
        found = sampling.numbered(rows, "k", name="n")
        assert found.columns == [*df.columns, "n"]
        spread = found.agg(F.count_distinct("n"), F.min("n"), F.max("n"), F.count(F.lit(1))).first()
        assert tuple(spread) == (300_000, 0, 299_999, 300_000)
        order = found.agg(F.max(F.struct("k", "n")).alias("a"), F.min(F.struct("k", "n")).alias("b")).first()
        assert order.a.n == 299_999 and order.b.n == 0


def test_helper_names_and_digests(spark):
    df = spark.createDataFrame([(1, "q", None), (1, None, "q"), (1, "q", None)], "id long, a string, B string")
    assert len({r.d for r in df.select(row_digest(df).alias("d")).collect()}) == 2
    assert fresh(spark.range(1).select(F.lit(1).alias("__X"), F.lit(1).alias("___x")), "x", "x", "y") == ("____x", "_____x", "__y")
    odd = spark.createDataFrame([("a", 1, 9), ("a", 2, 8)], "g string, at int, __n int")
    assert sampling.capped(odd, "g", "at", 1).collect()[0]["__n"] == 9 and sampling.balanced(odd, "g", "at", 1).columns == odd.columns


def test_group_split_keeps_groups_together(spark):
    parts = spark.range(2000).select((F.col("id") % 200).alias("w")).select("w", sampling.in_group_split(F.col("w"), 20).alias("p")).distinct()
    assert parts.count() == 200 and 15 < parts.where("p = 'validation'").count() < 70


def test_joins(spark):
    images = spark.createDataFrame([("a",), ("b",)], "stem string")
    xml = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), ("z", 1, "x")], "stem string, at int, xml string")
    assert {r.stem: (r.xml, r.has_document) for r in joins.with_document(images, xml, "stem", "at").collect()} == {"a": ("new", True), "b": (None, False)}
    assert joins.pairs(images, xml.where("at = 2"), "stem").count() == 1
    assert [r.stem for r in joins.lacking(images, xml, "stem").collect()] == ["b"] and [r.stem for r in joins.having(images, xml, "stem").collect()] == ["a"]
    truth = spark.createDataFrame([("a", "a b"), ("b", " "), ("c", "x")], "stem string, truth string")
    guess = spark.createDataFrame([("a", "m1", "a c"), ("c", "m1", "x"), ("a", "m2", "a b")], "stem string, model string, guess string")
    rates = reports.error_rates(joins.every_model(truth, guess, "stem", F.col("truth")), "truth", "guess")
    assert {r.model: (r.pages, r.missing, round(r.mean_wer, 3)) for r in reports.macro_average(rates, "model").collect()} == {"m1": (2, 0, 0.25), "m2": (1, 1, 0.0)}
    found = joins.with_guess(truth, guess.where("model = 'm2'"), "stem", F.col("truth"))
    assert {r.stem: r.status for r in found.collect()} == {"a": "ok", "c": "puudub"}


def test_reports(spark):
    df = spark.createDataFrame([("p1", "<m>a</m> <pb/> <m>b\nc</m>"), ("p2", "<m>x <i>y</i>"), ("p3", "plain")], "page string, t string")
    assert {r.tag: (r.openers, r.pages) for r in reports.tag_census(df, "page", "t").collect()} == {"m": (3, 2), "pb": (1, 1), "i": (1, 1)}
    audit = reports.note_audit(df, "t").first()
    assert (audit.opened, audit.closed, audit.single, audit.multi, audit.unbalanced) == (3, 2, 1, 1, 1)
    assert reports.break_position(df, "t").first().pages == 1
    assert [(r.page, r.n) for r in reports.group_count(df.unionAll(df.limit(1)), "page").collect()][0] == ("p1", 2)
    assert reports.shares(df, "page").agg(F.sum("share")).first()[0] == pytest.approx(1)
    assert reports.length_audit(df, "t", F.lit(10), 5, 17).where("too_long").count() == 2
    crossed = df.limit(1).select("page", F.lit("<i><cs></i></cs>\nok").alias("t"))
    assert [tuple(r) for r in reports.crossed_nesting(crossed, "t", "page").collect()] == [("p1", 1, "i", "cs", "<i><cs></i></cs>")]


def test_documented_audits(spark):
    df = spark.createDataFrame([("2026-03-04 05:06:07", "<m>a</m> <m>b\nc</m>"), ("2026-03-30 00:00:00", "<m>x</m>"), ("2026-04-01 00:00:00", "none")], "at string, t string").withColumn("at", F.to_timestamp("at"))
    assert {str(r.month): (r.single, r.multi, r.share) for r in reports.multiline_share(df, "t", "at").collect()} == {"2026-03-01": (2, 1, pytest.approx(1 / 3)), "2026-04-01": (0, 0, None)}
    sizes = spark.createDataFrame([(1, 2), (3, 2), (4, 2), (5, 0)], "w int, h int")
    assert tuple(reports.aspect_ratio(sizes, "w", "h").first()) == (3, 1.5)
    counts = spark.createDataFrame([(f"v{i}", i) for i in range(1200)], "v string, n int")
    lines = list(reports.lines_of(counts, "v"))
    assert len(lines) == 1200 and lines[0].split() == ["v1199", "1199"]
    pairs = spark.createDataFrame([("<i>a b</i> <pb/>", "<i>a c</i>", "ok"), ("x", None, "puudub")], "truth string, guess string, status string")
    rates = {r.status: (r.wer, r.tag_accuracy) for r in reports.markup_rates(pairs, "truth", "guess").collect()}
    assert rates["ok"] == (0.5, 0.5) and rates["puudub"][0] is None
    pages = spark.createDataFrame([("1", "diaryEntry"), ("2", "cover")], "facs string, kind string")
    assert [r.facs for r in provenance.of_kind(pages).collect()] == ["1"] and [r.facs for r in provenance.of_kind(pages, "cover").collect()] == ["2"]


def test_conversation_sample(spark):
    user, assistant = spark.range(1).select(samples.conversation(F.lit("do"), F.lit("x.jpg"), F.lit("text")).alias("m")).first().m
    assert (user.role, [c.type for c in user.content], user.content[1].image) == ("user", ["text", "image"], "x.jpg")
    assert (assistant.role, assistant.content[0].text, assistant.content[0].image) == ("assistant", "text", None)


@pytest.mark.parametrize("values", [[], [3.0], [1.0, 2.0], [0.0, -0.0, 5.5, None, -2.0, 5.5, 5.5], "many"])
def test_quantiles_by_selection(spark, values):
    if values == "many":
        rng = np.random.default_rng(3)
        values = [*rng.normal(size=3000).tolist(), *[0.25] * 2000, None]
    df = spark.createDataFrame([(v, "x") for v in values], "p double, v string").repartition(5)
    found = quantiles(df, F.col("p"), low=0.0, a=0.25, median=0.5, b=0.9, high=1.0)
    known, row = [v for v in values if v is not None], found.first()
    assert row.n == len(known)
    for name, share in (("low", 0.0), ("a", 0.25), ("median", 0.5), ("b", 0.9), ("high", 1.0)):
        assert row[name] == (pytest.approx(float(np.quantile(known, share)), abs=1e-12) if known else None)
    assert "percentile" not in found._jdf.queryExecution().toString().lower()


def test_digests_tell_nested_values_apart(spark):
    families = [
        ["named_struct('t', timestamp'2020-01-01 00:00:00.000001')", "named_struct('t', timestamp'2020-01-01 00:00:00.000002')", "named_struct('t', cast(null as timestamp))", "cast(null as struct<t timestamp>)"],
        ["array(1, null)", "array(null, 1)", "array(1)", "array(cast(null as int))", "cast(array() as array<int>)", "cast(null as array<int>)"],
        ["map('a', 1)", "map('a', null)", "map('b', 1)", "map('a', 1, 'b', 2)", "cast(map() as map<string, int>)"],
        ["array(named_struct('b', X'00'))", "array(named_struct('b', X''))", "array(named_struct('b', X'0000'))"],
        ["make_interval(0, 1)", "make_interval(0, 0, 0, 30)", "cast(null as interval)"],
        ["interval '1' second", "interval '1.000001' second"],
        ["0.0d", "-0.0d", "double('nan')"],
        ["parse_json('{\"a\": 1}')", "parse_json('{\"a\": \"1\"}')", "parse_json('null')", "cast(null as variant)"],
    ]
    for family in families:
        df = spark.sql(" union all ".join(f"select {x} as a, 1 as b" for x in family))
        assert df.select(row_digest(df)).distinct().count() == len(family), family
    swapped = spark.sql("select map('a', 1, 'b', 2) as a union all select map('b', 2, 'a', 1)")
    assert swapped.select(row_digest(swapped)).distinct().count() == 1


def time_rows(spark, seed):
    rng = random.Random(seed)
    moment = lambda: None if rng.random() < 0.03 else datetime(2024, 1, 1) + timedelta(minutes=rng.randrange(600))
    who = lambda: rng.choice([None, 1, 1, 1, 1, 2, 3])
    left = [(who(), moment(), i, "x") for i in range(300)]
    right = [(who(), moment(), 1000 + i, f"v{i}") for i in range(200)]
    return left, right, spark.createDataFrame(left, "k int, t timestamp, slice int, row string").repartition(3), spark.createDataFrame(right, "k int, t timestamp, id int, v string").repartition(2)


@pytest.mark.parametrize(("width", "within"), [(7, None), (60, 25), (100_000, None)])
def test_as_of_equals_a_search(spark, width, within):
    left, right, a, b = time_rows(spark, width)
    minute = 60_000_000
    got = sorted(tuple(r) for r in timejoins.as_of(a.where("slice >= 0"), b, "k", "t", ["id", "v"], "id", within and within * minute, width * minute).select("slice", "id", "v").collect())

    def last(k, t):
        some = [(u, i, v) for j, u, i, v in right if k is not None and t is not None and j == k and u is not None and u <= t and (within is None or t - u <= timedelta(minutes=within))]
        return max(some)[1:] if some else (None, None)

    key = lambda r: (r[0], str(r[1:]))
    assert sorted(got, key=key) == sorted(((i, *last(k, t)) for k, t, i, _ in left), key=key)
    assert timejoins.as_of(a, b.where("false"), "k", "t", ["id"], "id").where("id is null").count() == len(left)


@pytest.mark.parametrize("unit", [1, 60, 5000])
def test_points_in_intervals_equal_all_pairs(spark, unit):
    left, right, a, b = time_rows(spark, unit)
    rng = random.Random(unit)
    long_ = {i: rng.choice([-5, 0, 1, 2, 7, 60, 61, 500]) for _, _, i, _ in left}
    spans = a.join(spark.createDataFrame(list(long_.items()), "slice int, minutes int"), "slice").withColumnRenamed("t", "s").withColumn("e", F.expr("s + make_dt_interval(0, 0, minutes)"))
    got = sorted((r.slice, r.id) for r in timejoins.points_in(spans, b, "k", "s", "e", "t", unit * 60_000_000).collect())
    want = sorted((i, p) for k, s, i, _ in left for j, t, p, _ in right if k is not None and j == k and s is not None and t is not None and s <= t < s + timedelta(minutes=long_[i]))
    assert got == want and len(want) > 500
    assert timejoins.points_in(spans.where("false"), b, "k", "s", "e", "t").count() == 0
