import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quirefold.llm import quality, toxicity
from quirefold.llm.labelled import fold, training_rows


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    plain = [f"word{i}" for i in range(300)]
    rude = ["nasty", "vile", "grim", "foul"]
    docs, labels = [], []
    for i in range(900):
        text = [rng.choice(plain) for _ in range(rng.randint(20, 80))]
        bad, toxic = i % 4 == 0, i % 3 == 0
        if toxic:
            for _ in range(4):
                text.insert(rng.randrange(len(text)), rng.choice(rude) + rng.choice(["", ",", "!"]))
        body = " ".join(w.upper() + "!!" for w in text) if bad else " ".join(text) + "."
        docs.append((i, body, "x"))
        if i % 10 < 8:
            labels.append((i, int(not bad), int(toxic)))
    docs += [(None, "null id", "x"), (5000, None, "x"), (5001, "", "x"), (5002, "   ", "x"), (5003, "long " * 60_000, "x")]
    labels += [(7777, 1, 0), (None, 1, 1), (3, None, None), (1, 1, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string, score string").cache(), spark.createDataFrame(labels, "doc_id long, quality int, toxic int").cache()


def check(scored, truth, least):
    rows = scored.collect()
    assert all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in rows if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    known = [r for r in held if r.doc_id < 900]
    assert sum(r.predicted == truth(r.doc_id) for r in known) / len(known) >= least
    return {r.doc_id: r.score for r in rows}


def test_quality_on_held_out_rows(corpus):
    docs, labels = corpus
    first = check(quality.scored(docs, quality.fit(docs, labels)), lambda i: int(i % 4 != 0), 0.97)
    assert first == check(quality.scored(docs.repartition(5), quality.fit(docs.repartition(7), labels)), lambda i: int(i % 4 != 0), 0.97)
    assert quality.good_only(docs, quality.fit(docs, labels)).columns == docs.columns


def test_toxicity_on_held_out_rows(corpus):
    docs, labels = corpus
    check(toxicity.scored(docs, toxicity.fit(docs, labels)), lambda i: int(i % 3 == 0), 0.97)


def test_nothing_to_learn_from(spark, corpus, no_docs):
    docs, labels = corpus
    for label, module in (("quality", quality), ("toxic", toxicity)):
        for some in (labels.limit(0), labels.where(f"{label} = 1")):
            assert module.scored(docs, module.fit(docs, some)).count() == docs.count()
        assert module.scored(no_docs, module.fit(no_docs, labels)).count() == 0


def test_trees_equal_a_plain_walk():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 6)).astype(np.float32)
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] < -0.2)).astype(float)
    model = quality.grow(x, y, trees=30)
    assert ((model.score(x) > 0.5) == y).mean() > 0.97

    def walk(row):
        total = model.base
        for f, c, leaf in zip(model.feature, model.cut, model.leaf, strict=True):
            at = 0
            while at < len(f):
                at = 2 * at + 1 + (row[f[at]] > c[at])
            total += leaf[at - len(f)]
        return 1 / (1 + np.exp(-total))

    assert np.allclose([walk(r) for r in x[:50]], model.score(x[:50]))


def plain_kneser_ney(rows, every_text):
    """The two models by dictionaries: a function of word -> (P toxic, P ordinary), and the sets of units under each."""
    levels = lambda w: [w[:4], w[:6], w]
    counts, contexts = [Counter(), Counter()], set()
    for text, y in rows:
        words = text.split()
        for v, w in zip(["^", *words], words, strict=False):
            if (y, v, w) not in contexts:
                contexts.add((y, v, w))
                for i, u in enumerate(levels(w)):
                    counts[1 - y][i, u] += 1
    shared, under = Counter(), {}
    for text in every_text:
        for w in set(text.split()):
            for i, u in enumerate(levels(w)):
                shared[i, u] += 1
                under.setdefault((i - 1, levels(w)[i - 1] if i else ""), set()).add((i, u))
            shared[-1, ""] += 1
    d = toxicity.DISCOUNT

    def one(c, unit, parent):
        total = counts[c][parent] if parent[0] >= 0 else sum(n for (i, _), n in counts[c].items() if i == 0)
        share = max(shared[unit], 1) / (shared[parent] + 1)
        if not total:
            return share
        left = sum(min(counts[c][u], d) for u in under.get(parent, ()))
        return (max(counts[c][unit] - d, 0) + left * share) / total

    def word(w):
        path = [(-1, ""), *enumerate(levels(w))]
        return tuple(math.prod(one(c, path[i + 1], path[i]) for i in range(3)) for c in (0, 1))

    return word, one, under, shared


def test_toxicity_models_equal_plain_kneser_ney(spark):
    rng = random.Random(4)
    stems = ["abcdefg", "abcdxyz", "abcd", "grim", "grimly", "grimmer", "häß", "häßlichst", "o", "the", "zu"]
    text = lambda y: " ".join(rng.choice(stems if y else stems[:4] + stems[7:]) + rng.choice(["", "s", "er"]) for _ in range(30))
    rows = [(text(i % 2), i % 2) for i in range(40)]
    every = [t for t, _ in rows] + [text(0) for _ in range(30)] + ["never seen words"]
    labelled = spark.createDataFrame(rows, "text string, y int").repartition(3)
    counts, shared = toxicity.class_counts(labelled).cache(), toxicity.shared_counts(spark.createDataFrame([(t,) for t in every], "text string").repartition(4)).cache()
    known, root = toxicity.tables(counts, shared)
    found, top = known.toPandas(), root.first()
    two = lambda c: np.stack([found[f"{c}toxic"], found[f"{c}ordinary"]]).astype(float)
    everything = shared.where(F.col("unit") == int(toxicity.ROOT)).first()["n"]
    model = toxicity.kneser_ney(found["level"].to_numpy(), found["unit"].to_numpy(np.int64).view(np.uint64), found["parent"].to_numpy(np.int64).view(np.uint64), two(""), two("left_"), found["n"].to_numpy(), np.array([top["toxic"], top["ordinary"]], float), np.array([top["left_toxic"], top["left_ordinary"]], float), everything)
    word, one, under, totals = plain_kneser_ney(rows, every)
    for w in sorted({w for t in every for w in t.split()} | {"unheard", "abcdefgsss"}):
        p = word(w)
        data = np.frombuffer(w.encode(), np.uint8)
        _, levels, _ = toxicity.units(data, np.array([0, len(data)]))
        assert model.gains(levels)[0] == pytest.approx(math.log(p[0] / p[1]), abs=1e-9), w
    for parent, children in under.items():
        for c in (0, 1):
            rest = one(c, (parent[0] + 1, "\0"), parent)
            assert sum(one(c, u, parent) for u in children) + rest == pytest.approx(1)


def test_the_strongest_words_count():
    gain, first = np.array([1.0, 5, 2, 2, 7, -1, -2]), np.array([0, 0, 5, 7, 7])
    assert toxicity._strongest(gain, first).tolist() == [0, 14 / 3, -1.5, 0]


def test_samples_are_bounded_in_bytes(corpus):
    docs, labels = corpus
    some = training_rows(docs, labels, "toxic", 1000, max_bytes=20_000).select(F.sum(F.octet_length("text"))).first()[0]
    assert 15_000 < some <= 20_000
    assert toxicity.fit(docs, labels, max_bytes=0).weights[1] == 0


def test_statistics_equal_plain_python():
    texts = ["One two, two! Three\nthree three 4", "", "  ", "A B\tc.\n\nA B\tc.", "é" * 9 + " x1 (y) <z> LOUD"]
    raw = [t.encode() for t in texts]
    got = quality.statistics(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    names = len(quality.CLASS_NAMES)
    for row, text in zip(got, raw, strict=True):
        words, n = text.split(), max(len(text), 1)
        size, many = [len(w) for w in words], max(len(words), 1)
        mean = sum(size) / many
        kinds = [sum(quality._CLASS[b] == k for b in text) / n for k in range(names)]
        lower = [w.lower() for w in words]
        grams = [[tuple(lower[i : i + k]) for i in range(len(lower) - k + 1)] for k in (1, 2, 5)]
        repeats = [x for g in grams for x in (len(set(g)) / max(len(g), 1), max(Counter(g).values(), default=0) / max(len(g), 1))]
        lines = [tuple(line.lower().split()) for line in text.split(b"\n") if line.split()]
        punct = lambda b: bool(quality._IS_PUNCT[b])
        share = lambda test: sum(map(test, words)) / many
        want = [
            math.log1p(len(text)), *kinds, math.log1p(len(words)), mean, math.sqrt(max(0, sum(x * x for x in size) / many - mean**2)), math.log1p(max(size, default=0)),
            share(lambda w: len(w) <= 3), share(lambda w: len(w) > 12), share(lambda w: 2 * sum(65 <= b <= 90 for b in w) > len(w)),
            share(lambda w: punct(w[-1])), share(lambda w: punct(w[0])), share(lambda w: len(w) == 1), *repeats, sum(a == b for a, b in zip(lower, lower[1:], strict=False)) / many,
            math.log1p(len(lines)), len(words) / max(len(lines), 1), len(set(lines)) / max(len(lines), 1), max(Counter(lines).values(), default=0) / max(len(lines), 1),
            -sum(k * math.log(max(k, 1e-12)) for k in kinds),
        ]
        assert row.tolist() == pytest.approx(want, rel=1e-4, abs=1e-5)


@pytest.mark.parametrize("block", [1, 3, 7, 64, 1 << 20])
def test_class_counts_are_the_same_in_blocks_of_any_size(monkeypatch, block):
    monkeypatch.setattr(quality, "_BLOCK", block)
    raw = [b"", b"Ab 1.", b"", b"", b"\xc3\xa9" * 40, b" \n", b"x", b""]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    want = [[sum(quality._CLASS[b] == k for b in text) for k in range(len(quality.CLASS_NAMES))] for text in raw]
    assert quality._class_counts(quality._CLASS[data], offsets).tolist() == want
    nothing = quality._class_counts(np.zeros(0, np.uint8), np.zeros(3, np.int64))
    assert nothing.tolist() == [[0] * len(quality.CLASS_NAMES)] * 2


def test_a_very_long_text_counts_whole():
    text = "Word two, THREE\n" * 200_000
    both = quality.features(pa.array([text, "short one", text]))
    alone = quality.features(pa.array(["short one"]))
    assert (both[0] == both[2]).all() and (both[1] == alone[0]).all()
    names = quality.CLASS_NAMES
    assert both[0][1 + names.index("upper")] == pytest.approx(6 / 16) and both[0][1 + names.index("line")] == pytest.approx(1 / 16)


def test_fold_is_the_crc_of_the_text(spark):
    rows = spark.range(50).select("id", fold(F.col("id")).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 5 for r in rows)
