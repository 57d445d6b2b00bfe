import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quirefold.llm import links, merkle, minhash, ngram_join, spelling

LETTERS = "abcdeé"
DOC = "doc_id long, text string, source string, lang string, n_chars long, n string, block string"


def text_rows(seed=2):
    rng = random.Random(seed)
    words = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(3, 9))) for _ in range(60)]
    rows = []
    for i in range(120):
        some = []
        for _ in range(rng.randint(0, 60)):
            w = rng.choice(words)
            if rng.random() < 0.4:
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice(LETTERS) + w[at:], w[:at] + rng.choice(LETTERS) + w[at + 1 :]])
            some.append(w.upper() if rng.random() < 0.2 else w)
        rows.append((i, rng.choice([" ", ", ", "1", "ſ", "\n"]).join(some)))
    rows += [(None, rows[0][1]), (5, rows[5][1]), (200, None), (201, ""), (202, "a" * 3000), (203, "A" * 2999), (204, "a" * 3000)]
    rows += [(k, "a" * 3000) for k in (205, 206)] + [(k, "a" * 2999) for k in (207, 208)]
    return rows


def plain_words(rows):
    import re

    found = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


def one_apart(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


def plain_variants(rows):
    n = plain_words(rows)
    near = {w: [v for v in n if one_apart(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n[w], len(near[w]), n[form[w]] if form[w] else 0) for w in n)


@pytest.mark.parametrize("block", [3, 1 << 16])
def test_variants_equal_all_pairs(spark, block):
    rows = text_rows()
    df = spark.createDataFrame([(*r, None, None, None, None, None) for r in rows], DOC).repartition(5)
    got = sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in spelling.variants(df, block=block).collect())
    want = plain_variants(rows)
    assert got == want and sum(w[4] for w in want) > 50 and any(w[1] for w in want)


def test_variants_of_nothing(spark, no_docs):
    assert spelling.variants(no_docs).count() == 0
    assert spelling.variants(no_docs).columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_automata_are_minimal_and_number_their_words():
    rng = random.Random(1)
    words = sorted({bytes(rng.choice(b"abc\xe9") for _ in range(rng.randint(1, 7))) for _ in range(400)})
    automaton = spelling.Automaton.of(words)
    assert automaton.number(words).tolist() == list(range(len(words)))
    assert set(automaton.number([b"zz", b"", words[0] + b"zzz"]).tolist()) == {-1}

    def right(i=0, tree=None):  # the sets of endings of a plain tree
        tree = defaultdict(set)
        for w in words:
            for k in range(len(w) + 1):
                tree[w[:k]].add(w[k:])
        return {frozenset(v) for v in tree.values()}

    assert len(automaton.final) == len(right())
    who, number = automaton.near(words, np.array([len(w) // 2 for w in words]))
    got = {(words[w], words[k]) for w, k in zip(who, number, strict=True)}
    want = {(a, b) for a in words for b in words if one_apart(a, b) and b[: len(a) // 2] == a[: len(a) // 2] and one_apart(a[len(a) // 2 :], b[len(a) // 2 :])}
    assert got == want and len(who) == len(got)


def test_colliding_states_are_told_apart(monkeypatch):
    words = sorted({b"abcd", b"abd", b"bcd", b"xx", b"xyz", b"zzzz"})
    real, seeds = spelling.Automaton._same, []
    monkeypatch.setattr(spelling.Automaton, "_same", staticmethod(lambda *a: bool(seeds.append(1)) or (len(seeds) > 1 and real(*a))))
    assert spelling.Automaton.of(words).number(words).tolist() == list(range(len(words))) and len(seeds) == 2


def test_runs_in_pieces(monkeypatch):
    text = "Äpfel und ÀÿZ×x÷y naïve ſtop中foo " * 20
    whole = [w for piece in spelling.runs(text.encode()) for w in piece]
    monkeypatch.setattr(spelling, "_PIECE", 7)
    assert [w for piece in spelling.runs(text.encode()) for w in piece] == whole
    assert "Äpfel".encode() in whole and "Àÿz×x÷y".encode() in whole and b"top" in whole and b"foo" in whole
    assert list(spelling.runs(b"")) == []


# -- manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain_manifest(rows):
    """rows: doc_id, source, lang, n_chars, text."""

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            last = levels[-1]
            levels.append([sha(*last[i : i + 2]) for i in range(0, len(last), 2)])
        return levels

    def way(levels, i):
        return [(i >> k & 1, level[i >> k ^ 1] if i >> k ^ 1 < len(level) else None) for k, level in enumerate(levels[:-1])]

    leaf = lambda d, s, g, n, t: sha(*map(field, (d, s, g, n, t)))
    by = defaultdict(list)
    for d, s, g, n, t in rows:
        hit = d is not None and zlib.crc32(str(d).encode()) % 7 == 0 and n is not None
        by[g].append((d is not None, d or 0, leaf(d, s, g, n, t), leaf(d, s, g, n + 1, t) if hit else leaf(d, s, g, n, t), d))
    langs = sorted(by, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x[2] for x in sorted(by[g])]) for g in langs}
    top = tree([trees[g][-1][0] for g in langs])
    out = []
    for j, g in enumerate(langs):
        for i, (_, _, good, bad, d) in enumerate(sorted(by[g])):
            path, node = way(trees[g], i) + way(top, j), bad
            for odd, sibling in path:
                node = sha(node) if sibling is None else sha(sibling, node) if odd else sha(node, sibling)
            out.append((d, good, trees[g][-1][0], top[-1][0], sha(*(s for _, s in path if s)), node, node == top[-1][0]))
    return out


@pytest.mark.parametrize("bits", [1, 2, 10])
def test_manifest_equals_a_plain_tree(spark, bits):
    rng = random.Random(bits)
    rows = [(i, rng.choice([None, "s", "é"]), rng.choice([None, "en", "en", "en", "fr", "Z", "ß", ""]), rng.choice([None, 0, 9, 10]), rng.choice([None, "", "text", "ü" * 99])) for i in range(150)]
    rows += rows[3:6] + [(None, "s", "en", 1, "x"), (None, "s", "en", 1, "y"), (7, "s", "en", 1, "same id"), (900, None, "only", None, None)]
    df = spark.createDataFrame([(d, t, s, g, n, "clash", "clash") for d, s, g, n, t in rows], DOC).repartition(7)
    got = [tuple(r) for r in merkle.manifest(df, merkle.every_seventh(), bits).collect()]
    assert sorted(got, key=repr) == sorted(plain_manifest(rows), key=repr)
    assert not all(r[-1] for r in got) and any(r[-1] for r in got)


def test_manifest_of_little(spark, no_docs):
    assert merkle.manifest(no_docs, merkle.every_seventh()).count() == 0
    one = spark.createDataFrame([(1, None, None, None, None, None, None)], DOC)
    row = merkle.manifest(one, merkle.every_seventh()).first()
    assert row.leaf == row.subroot == row.root == row.folded_root == sha("1:1", *"----") and row.proof_sha256 == sha() and row.verified


# -- join


def plain_classes(texts, words, percent):
    def tokens(text):
        ws = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
        return frozenset(tuple(ws[i : i + words]) for i in range(max(1, len(ws) - words + 1))) if ws else frozenset()

    sets = [tokens(t) for t in texts]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [(i, len(s), find(i)) for i, s in enumerate(sets)]


def family_texts(seed):
    """Families whose members share most tokens, in all degrees of likeness, and lines that many hold."""
    rng = random.Random(seed)
    text = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    common, out = text(30), [None, "", " \n", "one", "One", "one two", "a b c d", "A b c D", "a b c d e"]
    for _ in range(12):
        base = text(rng.choice([6, 9, 20, 64, 120, 260]))
        for _ in range(rng.randint(2, 9)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
                at = rng.randrange(len(copy))
                copy[at : at + rng.choice([0, 1, 2])] = text(rng.choice([0, 1, 2]))
            out.append(" ".join(copy))
    out += [" ".join(common + text(rng.randint(0, 8))) for _ in range(25)] + [" ".join(text(40)) for _ in range(10)]
    return out


@pytest.mark.parametrize(("seed", "percent", "task"), [(1, 85, ngram_join.TASK), (2, 85, 40), (3, 60, 40), (4, 95, 400)])
def test_join_equals_all_pairs(spark, seed, percent, task):
    texts = family_texts(seed)
    df = spark.createDataFrame([(i, t, None, None, None, "k", "b") for i, t in enumerate(texts)], DOC).repartition(6)
    got = sorted(tuple(r) for r in ngram_join.similar_documents(df, percent, task=task).collect())
    want = plain_classes(texts, 4, percent)
    assert got == want and len({c for _, _, c in want}) < len(want) - 20


@pytest.mark.parametrize("percent", [60, 85])
def test_prefixes_of_similar_sets_share_a_key(percent):
    """With low limits, so that pairs and triples are what is shared."""
    rng = np.random.default_rng(5)
    counts = rng.integers(2, 40, 4000)
    for _ in range(400):
        n = int(rng.integers(5, 300))
        a = rng.choice(4000, n, replace=False)
        lost = int(rng.integers(0, ngram_join.slack(n, percent) + 1))
        b = np.concatenate([a[lost:], 4000 + np.arange(int(rng.integers(0, ngram_join.slack(n, percent) + 2)))])
        both = n - lost
        if 100 * both < percent * (n + len(b) - both):
            continue
        keys = []
        for s in (a, b):
            some = s[s < 4000]
            keys.append(set(ngram_join.keys_of(some.astype(np.uint64), counts[some], len(s), percent, limits=(8, 20), width=(32, 16)).tolist()))
        assert keys[0] & keys[1] or set(a) == set(b), (n, lost, len(b))


def test_keys_are_bounded():
    rng = np.random.default_rng(1)
    for n in (10, 100, 1000, 20_000):
        tokens = rng.integers(0, 2**63, n).astype(np.uint64)
        keys = ngram_join.keys_of(tokens, np.full(n, 5000), n, 85)
        assert 0 < len(keys) < 12 * n


def test_join_of_nothing_and_of_repeated_ids(spark, no_docs, docs_with_repeats):
    assert ngram_join.similar_documents(no_docs).count() == 0
    assert ngram_join.similar_documents(docs_with_repeats).count() == docs_with_repeats.count()


def test_bitmaps_never_differ_by_more_than_the_sets():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a = np.unique(rng.integers(0, 2**64, rng.integers(1, 900), dtype=np.uint64))
        b = np.unique(np.concatenate([rng.choice(a, rng.integers(0, len(a) + 1), replace=False), rng.integers(0, 2**64, rng.integers(0, 100), dtype=np.uint64)]))
        x, y = links.bitmap(a), links.bitmap(b)
        w = min(len(x), len(y))
        unlike = int(np.bitwise_count(links._folded(x, w) ^ links._folded(y, w)).sum())
        assert unlike <= len(np.setxor1d(a, b))


def test_buckets_that_hubs_leave_apart(spark, monkeypatch):
    """Tiny blocks, so that classes in one bucket are compared over several block pairs."""
    monkeypatch.setattr(links, "BLOCK", 4)
    rng = random.Random(9)
    base = [f"b{i}" for i in range(60)]
    texts = []
    for k in range(30):
        own = base[: 60 - k] + [f"x{k}_{i}" for i in range(k)]
        texts += [" ".join(own), " ".join(own[:-1] + ["end"])]
    rng.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for got, words in ((minhash.near_duplicates(df, 80), 5), (ngram_join.similar_documents(df, 80, task=200), 4)):
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == plain_classes(texts, words, 80)


def test_rows_without_id_meet_their_own_text_only(spark):
    """The join that fetches a vertex's text has as many rows as there are vertices and copies, not pairs."""
    words = [f"w{i}" for i in range(80)]
    texts = [" ".join(words[:i] + [f"new{i}"] + words[i:]) for i in range(80)]
    df = spark.createDataFrame([(None if i % 2 else 7, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = df.select("doc_id", "text", links.text_digest(F.col("text")).alias("digest"))
    wanted = rows.select(F.unhex(F.md5("text")).alias("vertex"), F.col("doc_id").alias("id"), "digest")
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["vertex"])

    joined = rows.withColumnRenamed("digest", "own").join(wanted, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("own") == F.col("digest")))
    joined.select("vertex").mapInArrow(count, "vertex binary").collect()
    assert seen.value == len(texts)
    assert links.sets_of(df, wanted, 5).count() == len(texts)
    assert {r.component_id for r in minhash.near_duplicates(df).collect()} == {7}
