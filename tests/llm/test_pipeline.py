"""The pipeline against plain Python, stage by stage and as a whole, and the llm queries against their SQL."""

import os
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from quirefold.llm import bpe, mixing, quality, registry
from quirefold.llm.common import table

from .test_dedup import bare, near_brute
from .test_tokens import expected

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = table(spark, SF, "documents"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        out.append(docs)
    return out


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_are_named_and_keep_the_columns(spark, stages):
    columns = table(spark, SF, "documents").columns
    assert len(corpus_pipeline.STAGES) == 5 and all(isinstance(n, str) and callable(f) for n, f in corpus_pipeline.STAGES)
    assert all(df.columns == columns for df in stages[:-1])


def test_each_stage_decides_as_plain_python_does(spark, stages):
    docs = table(spark, SF, "documents")
    model = quality.fit(docs, table(spark, SF, "labels"))
    good = by_id(stages[0])
    assert set(good) == {r.doc_id for r in quality.scored(docs, model).collect() if r.predicted == 1}

    groups = defaultdict(list)
    for r in good.values():
        groups[bare(r.text)].append((-len(r.text), r.doc_id))
    exact = by_id(stages[1])
    assert set(exact) == {min(g)[1] for g in groups.values()}

    near = by_id(stages[2])
    classes = near_brute([(r.doc_id, r.text) for r in exact.values()], 80)
    assert set(near) == {i for i, (_, name) in classes.items() if i == name}

    taken = Counter(r.doc_id for r in stages[3].collect())
    report = by_id(mixing.mix_report(stages[2]))
    assert {i: n for i, n in taken.items() if report[i].size} == {i: r.taken // r.size for i, r in report.items() if r.taken}
    sums, want = defaultdict(int), {}
    for i, r in report.items():
        sums[near[i].source] += r.taken
        want[near[i].source] = r.target
    assert all(abs(sums[s] - want[s]) <= 0.05 * want[s] + 60 for s in want)

    texts = {i: near[i].text for i in taken}
    ids = dict(zip(texts, expected("byte_bpe_50k.json", list(texts.values())), strict=True))
    last = stages[4].collect()
    assert Counter(r.doc_id for r in last) == taken
    assert all(bytes(r.ids) == ids[r.doc_id] and r.decoded == texts[r.doc_id] and r.n_tokens * 4 == len(r.ids) for r in last)


def test_run_equals_its_stages(spark, stages):
    key = lambda df: sorted((r.doc_id, r.n_tokens, bytes(r.ids)) for r in df.select("doc_id", "n_tokens", "ids").collect())
    assert key(corpus_pipeline.run(spark, SF)) == key(stages[-1])


def test_stages_take_empty_tables(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    found = duck.sql(registry.oracle_sql()[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    assert sorted(map(repr, (tuple(r) for r in df.select(*columns).collect()))) == sorted(map(repr, (tuple(r[i] for i in at) for r in found.fetchall())))


def test_queries_are_registered():
    assert [f"op{n}_" for n in range(1, 14)] == [q.split("_")[0] + "_" for q in sorted((q for q in registry.queries() if q.startswith("op")), key=lambda q: int(q[2:].split("_")[0]))]
    assert bpe.CACHE > 0
