import hashlib
import random
import zlib

import numpy as np
import pytest

from quirefold.llm import bpe, token_files

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")


def fuzz(n=1500, seed=2):
    rng = random.Random(seed)
    letters = list("abcdeté ß\n\t  \x1c\x85\xa0'sretlld0123456789.,!?中文字́Σσ😀\x00\x01\x0bZÅİ") + ["<|endoftext|>", "<|startoftext|>", " the", "  ", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"] + [chr(i) for i in range(0x80, 0x100)]
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def expected(name, texts):
    tokenizer = tokenizers.Tokenizer.from_file(public_tokenizers.path(name))
    return [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_bpe_equals_the_library(odd_texts):
    texts = fuzz() + [t or "" for t in odd_texts]
    model = bpe.Bpe(public_tokenizers.path("byte_bpe_50k.json"))
    got = model.encode(texts)
    assert got == expected("byte_bpe_50k.json", texts)
    assert [model.decode(x) for x in got] == texts
    assert 0 < model.repaired < model.speculated


def test_long_words_are_speculated_too():
    rng = random.Random(6)
    texts = ["".join(rng.choice("abcdeimnorst") for _ in range(n)) for n in (31, 33, 100, 255, 257, 300, 5000)] + ["=" * 700, "the" * 200, "中" * 400, "a" * 1000 + " b"]
    model = bpe.Bpe(public_tokenizers.path("byte_bpe_50k.json"))
    assert model.encode(texts) == expected("byte_bpe_50k.json", texts)
    assert model.speculated >= len(texts) > 0 and model.decoded(model.encode(texts)) == texts
    # a proposal whose bytes aren't the word's (as when hashes collide) is found and merged exactly
    honest = model._text_ids.copy()
    model._text_ids = np.roll(honest, 1)
    model.forget()
    assert model.encode(["hello there, plainly"]) == expected("byte_bpe_50k.json", ["hello there, plainly"])
    model._text_ids = honest


def test_every_token_is_its_own_encoding():
    model = bpe.Bpe(public_tokenizers.path("byte_bpe_50k.json"))
    assert all(model.merged(t) == [i] for t, i in model.ids.items())


def test_compatible_pairs_are_those_that_merging_leaves():
    model, rng = bpe.Bpe(public_tokenizers.path("byte_bpe_50k.json")), random.Random(4)
    ids = [i for i, b in enumerate(model.bytes) if b and len(b) < 9 and i not in model.special.values()]
    pairs = [(rng.choice(ids), rng.choice(ids)) for _ in range(4000)]
    got = model.compatible(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))
    assert got.tolist() == [model.merged(model.bytes[a] + model.bytes[b]) == [a, b] for a, b in pairs]


def test_bpe_column(docs_with_repeats, no_docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = bpe.encode(docs_with_repeats, path, decoded=True).collect()
    assert sorted(str(r.decoded) for r in rows) == sorted(r.text or "" for r in docs_with_repeats.collect())
    assert all(r.n_tokens * 4 == len(r.ids) for r in rows)
    again = bpe.decode(bpe.encode(docs_with_repeats, path), path)
    assert sorted(r.decoded for r in again.collect()) == sorted(r.decoded for r in rows)
    assert bpe.encode(no_docs, path).count() == 0


def test_other_kinds_of_file_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        bpe.Bpe(public_tokenizers.path("word_bpe_49k.json"))
    with pytest.raises(Exception, match="word"):
        token_files.CachedTokenizer(public_tokenizers.path("byte_bpe_50k.json"))


def test_cached_tokenizer_equals_the_library(odd_texts):
    texts = fuzz(seed=9) + [t or "" for t in odd_texts]
    cached = token_files.CachedTokenizer(public_tokenizers.path("word_bpe_49k.json"), cache=100)
    got = [x for i in range(0, len(texts), 200) for x in cached.encode(texts[i : i + 200])]
    assert got == expected("word_bpe_49k.json", texts)


def test_elias_fano():
    rng = np.random.default_rng(3)
    for n, top in ((1, 1), (2, 10), (700, 3), (700, 10**6), (3000, 40)):
        values = np.sort(rng.integers(0, top, n))
        packed = token_files.EliasFano.of(values)
        assert packed.all().tolist() == values.tolist() == [packed[i] for i in range(n)]
        assert packed.run(len(packed.samples) - 1).tolist() == values[(len(packed.samples) - 1) * token_files.SAMPLE :].tolist()


def test_token_files_round_trip(spark, docs, docs_with_repeats, no_docs, odd_texts, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    ids = [np.append(np.frombuffer(x, "<u4"), 1) for x in expected("word_bpe_49k.json", [t or "" for t in odd_texts])]
    starts = np.cumsum([0] + [len(x) for x in ids])
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.token_files(docs, path, 1, folder=f"file://{tmp_path}/a", shard_ids=700).collect()}
    assert got == {i: (starts[i], len(x), zlib.crc32(x.astype("<u4").tobytes())) for i, x in enumerate(ids)}
    names = sorted(p.name for p in (tmp_path / "a").iterdir() if p.suffix == ".qef")
    assert len(names) > 4
    shards = [token_files.Shard((tmp_path / "a" / n).read_bytes()) for n in names]
    assert np.concatenate([s.ids for s in shards]).tolist() == np.concatenate(ids).tolist()
    assert [s.document(i).tolist() for s in shards for i in range(len(s))] == [x.tolist() for x in ids]
    # a file that a lost attempt left is never read, though it lies beside the others and is whole
    (tmp_path / "a" / f"{names[0][:12]}-00000-lost.qef").write_bytes((tmp_path / "a" / names[0]).read_bytes())
    (tmp_path / "a" / "part-0000000-00009-torn.qef").write_bytes(b"QEF1 torn")
    assert sorted(r.doc_id for r in token_files.read_shards(spark, f"file://{tmp_path}/a").collect()) == list(range(len(odd_texts)))
    assert token_files.token_files(docs_with_repeats, path, 1).count() == docs_with_repeats.count()
    assert token_files.token_files(no_docs, path, 1).count() == 0


def test_ids_digest_is_of_little_endian_words():
    assert hashlib.sha256(bpe.loaded(public_tokenizers.path("byte_bpe_50k.json")).encode(["hello"])[0]).hexdigest() == hashlib.sha256(np.array([31373], "<u4").tobytes()).hexdigest()
