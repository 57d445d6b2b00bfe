import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from quirefold.llm import components, exact_dedup, links, minhash, substrings

from .conftest import BLANK, words


def bare(text):
    return "".join(c for c in text or "" if c not in BLANK)


def exact_brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[bare(t)].append((-len(t or ""), i))
    return {i: (min(groups[bare(t)])[1], len(groups[bare(t)]), hashlib.sha256(bare(t).encode()).hexdigest()) for i, t in rows}


def test_exact_groups_equal_brute_force(docs, odd_texts):
    want = exact_brute(list(enumerate(odd_texts)))
    got = exact_dedup.exact_groups(docs).collect()
    assert len(got) == len(odd_texts)
    for r in got:
        assert (r.keep_id, r.group_size, r.text_sha256) == want[r.doc_id] and r.kept == (r.doc_id == r.keep_id)


def test_exact_collisions_never_merge_texts(docs, odd_texts, monkeypatch):
    real = exact_dedup._rows
    monkeypatch.setattr(exact_dedup, "_rows", lambda *a: real(*a).withColumn("h", F.substring("h", 1, 0)))
    want = exact_brute(list(enumerate(odd_texts)))
    assert {r.doc_id: (r.keep_id, r.group_size, r.text_sha256) for r in exact_dedup.exact_groups(docs).collect()} == want


def test_exact_repeats_empty_and_columns(docs_with_repeats, no_docs, docs, odd_texts):
    assert exact_dedup.exact_groups(docs_with_repeats).count() == docs_with_repeats.count()
    assert exact_dedup.exact_groups(no_docs).count() == 0
    for df in (docs, docs_with_repeats):
        kept = exact_dedup.deduplicated(df)
        assert kept.columns == df.columns
        texts = [bare(r.text) for r in kept.collect()]
        assert len(texts) == len(set(texts)) and set(texts) == {bare(r.text) for r in df.collect()}


def shingles(text):
    w = [x.decode().lower() if x.isascii() else x.lower().decode() for x in words(text)]
    return set(zip(*(w[i:] for i in range(5)), strict=False)) if len(w) >= 5 else {tuple(w)} - {()}


def near_brute(rows, percent):
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates_equal_brute_force(docs, odd_texts, monkeypatch):
    for percent, block in ((85, 256), (80, 4)):
        monkeypatch.setattr(links, "BLOCK", block)
        want = near_brute(list(enumerate(odd_texts)), percent)
        got = minhash.near_duplicates(docs, percent).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_odd_tables(docs_with_repeats, no_docs, docs):
    assert minhash.near_duplicates(no_docs).count() == 0
    assert minhash.near_duplicates(docs_with_repeats).count() == docs_with_repeats.count()
    kept = minhash.without_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.where("text is null").count() == 1


def test_near_duplicates_go_by_row(spark):
    long, other, third = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    cases = [
        ([(1, long), (None, long + " z"), (None, other), (None, "few words")], {long, other, "few words"}),
        ([(1, long), (2, long + " z"), (2, other)], {long, other}),
        ([(2, long), (1, long + " z"), (1, other)], {long + " z", other}),
        ([(None, other), (None, third), (None, None), (None, " ")], {other, third, None, " "}),
        ([(5, other), (5, other), (4, third), (None, None), (None, None)], [other, third, None, None]),
    ]
    for rows, want in cases:
        df = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string")
        kept = minhash.without_near_duplicates(df)
        assert kept.columns == df.columns and sorted(map(str, (r.text for r in kept.collect()))) == sorted(map(str, want))
    for i in (7, None):
        df = spark.createDataFrame([(i, long), (i, long + " z"), (i, long + " z"), (i, other)], "doc_id long, text string")
        texts = [r.text for r in minhash.without_near_duplicates(df).collect()]
        assert len(texts) == 2 and other in texts


def test_exact_copies_of_one_id_leave_the_longest(spark):
    for i in (7, None):
        df = spark.createDataFrame([(i, "a b"), (i, "a  b"), (i, "ab"), (i, "c")], "doc_id long, text string")
        assert sorted(r.text for r in exact_dedup.deduplicated(df).collect()) == ["a  b", "c"]


def test_chain_of_links_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (205, 200), (205, 203)], "u long, v long")
    got = {r.node: r.root for r in components.components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100, 203: 200, 205: 200}


def test_signature_is_one_shifted_permutation():
    import numpy as np

    some = [np.arange(50, dtype=np.uint64) * np.uint64(977)]
    sig = minhash.signatures(some, 8)
    points = minhash.mix(some[0] ^ minhash._FIRST)
    assert sig[0].tolist() == [int(minhash.mix(points + np.uint64(k) * minhash._STEP).min()) for k in range(8)]


def removal_brute(rows, window):
    starts = defaultdict(int)
    for _, t in rows:
        w = words(t)
        for i in range(len(w) - window + 1):
            starts[tuple(w[i : i + window])] += 1
    out = []
    for i, t in rows:
        w = words(t)
        gone = {j for k in range(len(w) - window + 1) if starts[tuple(w[k : k + window])] > 1 for j in range(k, k + window)}
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest()))
    return sorted(out, key=str)


def test_repeated_spans_equal_brute_force(docs, docs_with_repeats, no_docs):
    for df, window, anchor in ((docs, 35, 10), (docs_with_repeats, 35, 10), (docs, 6, 3), (docs, 12, 12)):
        got = substrings.digest(substrings.without_repeats(df, window, anchor)).collect()
        assert sorted((tuple(r) for r in got), key=str) == removal_brute([(r.doc_id, r.text) for r in df.collect()], window)
    assert substrings.without_repeats(no_docs).count() == 0


def test_colliding_hashes_never_remove_a_word(docs):
    got = substrings.digest(substrings.without_repeats(docs, 6, 3, bits=7)).collect()
    assert sorted((tuple(r) for r in got), key=str) == removal_brute([(r.doc_id, r.text) for r in docs.collect()], 6)


def test_rows_that_repeat_a_text_are_rows_like_any_other(spark):
    text = " ".join(f"w{i}" for i in range(90))
    df = spark.createDataFrame([(None, text)] * 40 + [(1, text + " tail"), (2, "quite " * 4)], "doc_id long, text string").repartition(3)
    got = substrings.digest(substrings.without_repeats(df)).collect()
    assert sorted((tuple(r) for r in got), key=str) == removal_brute([(r.doc_id, r.text) for r in df.collect()], 35)


def test_nonbranching_paths_are_one_span(spark):
    passage, other = " ".join(f"p{i}" for i in range(120)), " ".join(f"q{i}" for i in range(80))
    texts = [f"a b {passage} c", f"d {passage} {other} e", f"f {other} g", "h " + " ".join(f"z{i}" for i in range(60))]
    df = spark.createDataFrame(list(enumerate(texts)), "t long, text string")
    spans = substrings.repeated_spans(df).collect()
    # paths end at documents' own words, so a passage is its inner path and the windows at its ends
    assert len(spans) < 0.2 * sum(s.n for s in spans) and max(s.n for s in spans) > 40
    names = {}
    for s in spans:
        words = " ".join(texts[s.t].split()[s.at : s.at + s.n + 34])
        assert names.setdefault((s.a, s.b), words) == words


def test_smallest_is_leftmost():
    import numpy as np

    g = np.array([5, 3, 3, 9, 1, 1, 7], np.uint64)
    for n in range(1, 8):
        assert substrings.smallest(g, n).tolist() == [i + int(np.argmin(g[i : i + n])) for i in range(len(g) - n + 1)]
