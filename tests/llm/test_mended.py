"""Cases that once went wrong, at the size at which they did."""

import itertools
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirefold.llm import chat, exact_dedup, mixing, substrings, toxicity
from quirefold.llm.labelled import training_rows


def labelled(spark, texts, toxic):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return docs, spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)], "doc_id long, quality int, toxic int")


def test_a_long_labelled_text_costs_only_itself(spark):
    texts = [" ".join(f"w{(i * k) % 97}" + (" vile" if i % 3 == 0 and k % 9 == 0 else "") for k in range(1, 40)) for i in range(400)]
    docs, labels = labelled(spark, texts, [int(i % 3 == 0) for i in range(400)])
    learnt = docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    every = training_rows(docs, labels, "toxic", 1000).count()
    first = {r.doc_id for r in learnt.orderBy(F.xxhash64(F.lit(7), "doc_id"), "doc_id").limit(40).collect()}
    longer = docs.withColumn("text", F.when(F.col("doc_id").isin(list(first)), F.expr("repeat('long ', 300000)")).otherwise(F.col("text")))
    some = training_rows(longer, labels, "toxic", 1000, max_bytes=1 << 20)
    assert every == learnt.count() and some.count() == every - len(first)
    one = docs.withColumn("text", F.when(F.col("doc_id").isin(list(first)[:1]), F.expr("repeat('long ', 300000)")).otherwise(F.col("text")))
    model = toxicity.fit(one, labels, max_bytes=1 << 20)
    assert model.weights[1] > 0 and len(model.keys[-1])


def test_equal_texts_with_unlike_labels_give_one_model(spark):
    texts = [f"{'vile' if i % 2 else 'calm'} words {i % 20} and {i % 7} more" for i in range(300)]
    docs, labels = labelled(spark, texts, [int(i % 2 or i % 30 == 0) for i in range(300)])
    models = [toxicity.fit(docs.repartition(n), labels.repartition(n)) for n in (1, 3, 5, 8)]
    for model in models[1:]:
        assert model.weights == models[0].weights
        assert all(np.array_equal(a, b) for x, y in zip((model.keys, model.gain, model.back), (models[0].keys, models[0].gain, models[0].back), strict=True) for a, b in zip(x, y, strict=True))


def test_one_class_in_the_fifth_set_aside(spark):
    texts = ["vile thing here", "calm thing here"] * 4
    docs, labels = labelled(spark, [f"{t} {i}" for i, t in enumerate(texts)], [1, 0] * 4)
    model = toxicity.fit(docs, labels)
    assert np.isfinite(model.weights).all()


def test_equal_turns_are_as_many_turns(spark):
    turns = spark.createDataFrame([(1, None, "user", "ok"), (1, None, "user", "ok"), (1, 3, "assistant", "yes")], "conv_id long, turn long, role string, text string")
    rows = chat.repaired(turns).orderBy("place").collect()
    assert [(r.turn, r.role, r.action) for r in rows] == [(None, "user", "stay"), (None, "user", "merge"), (3, "assistant", "stay")]
    assert chat.rendered(turns).first().text.count("ok") == 2


@pytest.mark.parametrize("copies", [1, 3, 8, 9, 50])
def test_many_equal_turns_share_no_run(spark, copies):
    rows = [(1, 5, "user", "again")] * copies + [(1, 5, "assistant", f"a{i}") for i in range(20)] + [(1, 6, "assistant", "end"), (2, None, None, None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    cut, whole = (chat.repaired(turns, run=run).collect() for run in (4, 4096))
    assert len(cut) == len(whole) == len(rows)
    assert Counter((r.conv_id, r.turn, r.role) for r in cut) == Counter((c, t, r) for c, t, r, _ in rows)
    total = lambda rows: sum(r.cost + chat.INSERT * len(r.closing) for r in rows)
    # a run of 4096 holds them all, where none is heavy: another order, so compare with the order that was taken
    order = [chat.role_number(r.role) for r in sorted((r for r in cut if r.conv_id == 1), key=lambda r: r.place)]
    states = chat.path(order, chat.START, int((chat.product(order)[chat.START] + chat.FINISH).argmin()))
    least = sum(chat.STEPS[r][s, t][0] for r, s, t in zip(order, [chat.START, *states], states, strict=False)) + chat.INSERT * len(chat.CLOSE[states[-1]])
    assert total([r for r in cut if r.conv_id == 1]) == least
    assert max(len(x.turns) for x in chat._runs(turns, "conv_id", "turn", "role", "text", 4).collect()) <= 21


@pytest.mark.parametrize("share", [0.1, 0.5, 0.83])
def test_few_long_documents_take_little_memory(share):
    rng = np.random.default_rng(1)
    for n, words in ((12, 5_000_000), (12, 100_000_000), (60, 5_000_000), (200, 3_000_000)):
        lengths = np.unique(rng.integers(words // 2, words, n))
        budget = int(lengths.sum() * share)
        tracemalloc.start()
        try:
            take = mixing.fit(lengths, np.ones(len(lengths), np.int64), budget)
            peak = tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()
        off = abs(int((take * lengths).sum()) - budget)
        assert peak < 64 << 20 and set(take.tolist()) <= {0, 1}
        if n == 12:
            assert off == min(abs(sum(c) - budget) for k in range(n + 1) for c in itertools.combinations(lengths.tolist(), k))
        else:
            assert off == 0


def test_halves_equal_the_knapsack():
    rng = np.random.default_rng(2)
    for _ in range(60):
        lengths = np.unique(rng.integers(1, 60, 5))
        counts = rng.integers(0, 4, len(lengths))
        budget = int(rng.integers(0, int((lengths * counts).sum()) + 2))
        a, b = (int((f(lengths, counts, budget) * lengths).sum()) for f in (mixing._by_halves, mixing._subset))
        assert a == b


def test_equal_rows_but_for_a_microsecond_both_stay_in_the_mix(spark):
    rows = spark.sql("""select id as doc_id, 'one two three' as text, 's' as source, named_struct('t', timestamp_micros(1600000000000000 + id)) as seen from range(6)""").drop("doc_id").withColumn("doc_id", F.lit(1))
    taken = mixing.mix(rows, budget=1.0, cap=1.0)
    assert taken.count() == taken.distinct().count() == 6


def test_a_word_over_and_over_is_one_span(spark):
    rep, phrase = "re " * 150_000, "x y z w "
    df = spark.createDataFrame([(1, rep), (2, "a b " * 300), (3, phrase * 200 + "tail"), (4, phrase * 100), (5, rep[:120_000]), (6, "lone words " + " ".join(f"w{i}" for i in range(60)))], "doc_id long, text string")
    spans = substrings.repeated_spans(df.select(F.col("doc_id").alias("t"), "text")).groupBy("t").count().collect()
    assert {r.t: r["count"] for r in spans if r.t in (1, 5)} == {1: 1, 5: 1} and max(r["count"] for r in spans) < 20
    found = {r.doc_id: (r.n_words, r.n_removed) for r in substrings.without_repeats(df).collect()}
    assert found == {1: (150_000, 150_000), 2: (600, 600), 3: (801, 800), 4: (400, 400), 5: (40_000, 40_000), 6: (62, 0)}


def test_of_rows_equal_in_id_and_text_one_stays_by_its_fields(spark):
    rows = spark.createDataFrame([(1, "same text", f"s{i}") for i in range(9)] + [(2, "other", "t")], "doc_id long, text string, source string")
    kept = [sorted((r.doc_id, r.source) for r in exact_dedup.deduplicated(rows.repartition(n)).collect()) for n in (1, 2, 5, 7)]
    assert all(k == kept[0] and len(k) == 2 for k in kept)
