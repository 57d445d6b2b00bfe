"""Operator 5: byte-level BPE encoding and decoding by speculation and verification.

A text is cut at single spaces between non-blank characters (a token never spans such a cut), and each distinct piece is
encoded once per worker cache. The words of all new pieces of a batch are tokenised together:

1. speculate: greedy longest match proposes each word's tokens, for all words at once by hashes of their parts (for the
   few words of more than `LONG` bytes by the parts themselves);
2. verify: the tokens' bytes are compared with the words', and every adjacent pair of proposed tokens is tested,
   vectorised over the batch. A sequence is what the merges give if and only if no adjacent pair would have been merged
   across: the test undoes the merges that made the two tokens, latest first, and asks at each step whether the two parts
   that touch would have merged earlier;
3. only words that fail are merged exactly: side by side, the long ones with a heap.

Decoding is one gather over a table of all tokens' bytes for all texts of a batch.

The result equals the `tokenizers` library's for byte-level BPE without normaliser (the file is read as it stands;
other kinds of file are refused). The added tokens' strings in a text become their ids, as in the library.

Defined cases: null text is empty and has no ids; decoding gives back the very text, bytes that are no UTF-8 become
U+FFFD; one very long word costs n log n. The cache has a fixed size, so memory follows one Arrow batch.
"""

from __future__ import annotations

import heapq
import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import tidy
from quirefold.llm.words import mix, powers

# Fixed value of this family of tokenizers: the pattern that splits text before the merges.
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_LOOSE = re.compile(r"^ | $| \s|\s ")
_MARK = "\ue000"
_NEVER = np.int64(2**62)
CACHE, LONG = 120_000, 256
#: Texts are taken through in parts of about so many characters.
PART = 2_000_000


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    spare = (chr(256 + i) for i in range(256))
    return {chr(b) if b in plain else next(spare): b for b in range(256)}


class Lookup:
    """Integer keys to their places in a table, vectorised: one slot a key, the few that share one are searched."""

    def __init__(self, keys: np.ndarray, bits: int = 20):
        self.keys, self._shift = keys.astype(np.uint64), np.uint64(64 - bits)
        self._slots = np.full(1 << bits, -1, np.int32)
        slot = self._slot(self.keys)
        self._slots[slot[::-1]] = np.arange(len(keys) - 1, -1, -1, dtype=np.int32)
        spill = np.flatnonzero(self._slots[slot] != np.arange(len(keys)))
        self._spill = spill[np.argsort(self.keys[spill])]
        self._spill_keys = self.keys[self._spill]
        self._shared = np.zeros(1 << bits, bool)
        self._shared[slot[spill]] = True

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> self._shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        shape, keys = keys.shape, keys.astype(np.uint64, copy=False).ravel()
        slot = self._slot(keys)
        at = self._slots[slot]
        out = np.where((at >= 0) & (self.keys[at] == keys), at, -1)
        if len(odd := np.flatnonzero((out < 0) & self._shared[slot])):
            place = np.minimum(np.searchsorted(self._spill_keys, keys[odd]), len(self._spill) - 1)
            out[odd] = np.where(self._spill_keys[place] == keys[odd], self._spill[place], -1)
        return out.reshape(shape)


class Bpe:
    """Tables of one tokenizer file, and a cache of two generations."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        if model["type"] != "BPE" or spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or model.get("end_of_word_suffix") or model.get("continuing_subword_prefix"):
            raise ValueError(f"{path}: only byte-level BPE without normaliser, prefix space or word ends")
        letters, vocab = byte_letters(), model["vocab"]
        size = 1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])])
        self.bytes: list[bytes] = [b""] * size
        for text, i in vocab.items():
            self.bytes[i] = bytes(letters[c] for c in text)
        self.ids = {b: i for i, b in enumerate(self.bytes) if b}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        for text, i in self.special.items():
            self.bytes[i] = text.encode()
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in reversed(list(enumerate(pairs)))}
        #: rank of the merge that makes a token (-1: a single byte), and the two parts it merges
        self.made = np.full(size, -1, np.int64)
        self.left, self.right = np.arange(size), np.arange(size)
        for (a, b), (rank, whole) in sorted(self.merges.items(), key=lambda x: -x[1][0]):
            self.made[whole], self.left[whole], self.right[whole] = rank, a, b
        self._pairs = Lookup(np.array([a << 32 | b for a, b in self.merges]))
        self._ranks = np.array([r for r, _ in self.merges.values()] + [_NEVER], np.int64)
        self._whole = np.array([w for _, w in self.merges.values()] + [-1], np.int64)
        self._byte_ids = np.array([self.ids[bytes([i])] for i in range(256)], np.int64)
        known = list(self.ids.items())
        data = np.frombuffer(b"".join(t for t, _ in known), np.uint8)
        ends = np.cumsum([len(t) for t, _ in known])
        self._texts = Lookup(_spans(data, ends - np.diff(ends, prepend=0), ends))
        self._text_ids = np.array([i for _, i in known], np.int64)
        self._longest = np.ones(1 << 16, np.int64)  # of the tokens that start with these two bytes
        for t, _ in known:
            if len(t) > 1:
                self._longest[t[0] << 8 | t[1]] = max(self._longest[t[0] << 8 | t[1]], len(t))
        #: all tokens' bytes end to end, for decoding and for checks
        self._flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self._sizes = np.array([len(b) for b in self.bytes], np.int64)
        self._starts = np.cumsum(self._sizes) - self._sizes
        self._new: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}
        self.speculated = self.repaired = 0

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair whether the merges leave the border between the two tokens alone."""
        a, b = a.astype(np.int64), b.astype(np.int64)
        out, live, limit = np.ones(len(a), bool), np.arange(len(a)), np.full(len(a), _NEVER)
        while len(live):
            bad = self._ranks[self._pairs(a << 32 | b)] < limit
            out[live[bad]] = False
            made_a, made_b = self.made[a], self.made[b]
            go = ~bad & ((made_a >= 0) | (made_b >= 0))
            live, a, b, made_a, made_b = live[go], a[go], b[go], made_a[go], made_b[go]
            undo = made_a > made_b
            limit = np.where(undo, made_a, made_b + 1)
            a, b = np.where(undo, self.right[a], a), np.where(undo, b, self.left[b])
        return out

    def _speculate(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match of all words at once: word and token of each proposed token, in order."""
        sums = _sums(data)
        after = np.append(data[1:], 0).astype(np.int64)
        longest = self._longest[data.astype(np.int64) << 8 | after]
        at, live, words, tokens = starts.copy(), np.arange(len(starts)), [], []
        while len(live):
            here = at[live]
            size = np.minimum(longest[here], ends[live] - here)
            token = np.full(len(live), -1, np.int64)
            todo = np.arange(len(live))
            while len(todo):
                a, n = here[todo], size[todo]
                found = self._texts(_between(sums, a, a + n))
                proposed = np.where(n == 1, self._byte_ids[data[a]], self._text_ids[found])
                hit = (n == 1) | (found >= 0) & (self._sizes[proposed] == n)
                token[todo[hit]] = proposed[hit]
                todo = todo[~hit]
                size[todo] -= 1
            words.append(live)
            tokens.append(token)
            at[live] += size
            live = live[at[live] < ends[live]]
        word, token = np.concatenate(words), np.concatenate(tokens)
        order = np.argsort(word, kind="stable")
        return word[order], token[order]

    def _propose(self, word: bytes) -> list[int]:
        """Greedy longest match of one long word."""
        out, at, ids, longest = [], 0, self.ids, self._longest
        while at < len(word):
            size = min(int(longest[word[at] << 8 | word[at + 1]]) if at + 1 < len(word) else 1, len(word) - at)
            while (token := ids.get(word[at : at + size])) is None:
                size -= 1
            out.append(token)
            at += size
        return out

    def spelled(self, tokens: np.ndarray) -> np.ndarray:
        """The bytes of all tokens, end to end."""
        sizes = self._sizes[tokens]
        return self._flat[np.repeat(self._starts[tokens] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))]

    def _merge_rows(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        """Exact merging of short words side by side: in each round every word makes its next merge."""
        n, wide = ends - starts, int((ends - starts).max())
        cols = np.arange(wide)
        ids = np.where(cols < n[:, None], self._byte_ids[data[np.minimum(starts[:, None] + cols, len(data) - 1)]], -1)
        ids = np.concatenate([ids, np.full((len(ids), 1), -1)], axis=1)

        def look(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return np.where((a >= 0) & (b >= 0), self._pairs((a & 0xFFFFFFFF) << 32 | (b & 0xFFFFFFFF)), -1)

        out: list = [None] * len(ids)
        rows, pair = np.arange(len(ids)), look(ids[:, :-1], ids[:, 1:])
        while True:
            rank = self._ranks[pair]
            j = rank.argmin(axis=1)
            every = np.arange(len(ids))
            done = rank[every, j] == _NEVER
            for i in np.flatnonzero(done).tolist():
                out[rows[i]] = ids[i][ids[i] >= 0]
            if done.all():
                return out
            go = ~done
            ids, pair, rows, j = ids[go], pair[go], rows[go], j[go]
            every = np.arange(len(ids))
            whole = self._whole[pair[every, j]]
            ids = np.where(np.arange(wide + 1) <= j[:, None], ids, np.concatenate([ids[:, 1:], np.full((len(ids), 1), -1)], axis=1))
            pair = np.where(cols <= j[:, None], pair, np.concatenate([pair[:, 1:], np.full((len(ids), 1), -1)], axis=1))
            ids[every, j] = whole
            pair[every, j] = look(whole, ids[every, j + 1])
            back = np.maximum(j - 1, 0)
            pair[every, back] = np.where(j > 0, look(ids[every, back], whole), pair[every, back])

    def merged(self, word: bytes) -> list[int]:
        """Exact merging of one word: lowest rank first, of equal ranks the leftmost."""
        ids = [self.ids[word[i : i + 1]] for i in range(len(word))]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        merges, n = self.merges, len(ids)
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, whole = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = whole, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := merges.get((whole, ids[k])):
                    heapq.heappush(heap, (m[0], i, whole, ids[k], m[1]))
            if (h := before[i]) >= 0 and (m := merges.get((ids[h], whole))):
                heapq.heappush(heap, (m[0], h, ids[h], whole, m[1]))
        return [i for i in ids if i >= 0]

    def _learn(self, words: list[str]) -> list[bytes]:
        """The ids of each word (none is empty)."""
        raw = [w.encode() for w in words]
        if not raw:
            return []
        # long words last, so that the proposals of both kinds lie in the words' order
        order = sorted(range(len(raw)), key=lambda i: len(raw[i]) > LONG)
        raw = [raw[i] for i in order]
        data, sizes = np.frombuffer(b"".join(raw), np.uint8), np.fromiter(map(len, raw), np.int64, len(raw))
        ends = np.cumsum(sizes)
        starts, near = ends - sizes, int((sizes <= LONG).sum())
        word, token = self._speculate(data, starts[:near], ends[:near]) if near else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        far = [self._propose(w) for w in raw[near:]]
        word = np.concatenate([word, np.repeat(np.arange(near, len(raw)), [len(t) for t in far])])
        token = np.concatenate([token, *(np.array(t, np.int64) for t in far)])
        wrong = np.zeros(len(raw), bool)
        wrong[np.searchsorted(ends, np.flatnonzero(self.spelled(token) != data), "right")] = True
        inner = np.flatnonzero(word[1:] == word[:-1])
        pairs, back = np.unique(token[inner] << 32 | token[inner + 1], return_inverse=True)
        good = self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)[back]
        wrong[word[inner[~good]]] = True
        self.speculated += len(raw)
        self.repaired += int(wrong.sum())
        flat, bounds = token.astype("<u4").tobytes(), (4 * np.searchsorted(word, np.arange(len(raw) + 1))).tolist()
        found = [flat[bounds[k] : bounds[k + 1]] for k in range(len(raw))]
        failing = np.flatnonzero(wrong[:near])
        # words of like lengths side by side, so that short ones aren't padded to the longest
        for low, high in ((0, 16), (16, 48), (48, LONG)):
            some = failing[(sizes[failing] > low) & (sizes[failing] <= high)]
            for at in range(0, len(some), 4096):
                part = some[at : at + 4096]
                for k, ids in zip(part.tolist(), self._merge_rows(data, starts[part], ends[part]), strict=True):
                    found[k] = ids.astype("<u4").tobytes()
        for k in (near + np.flatnonzero(wrong[near:])).tolist():
            found[k] = np.array(self.merged(raw[k]), "<u4").tobytes()
        out: list = [b""] * len(raw)
        for k, i in enumerate(order):
            out[i] = found[k]
        return out

    def _encode_pieces(self, pieces: list[str]) -> None:
        known, find, parts = self._new, WORD.findall, {}
        fresh = dict.fromkeys(p for p in pieces if p[1:].isalpha() and (p[0] == " " or p[0].isalpha()))  # one word each
        rest = [p for p in pieces if p not in fresh]
        for piece in rest:
            part: list[str | int] = []
            at = 0
            for m in self._special.finditer(piece) if self._special else ():
                part += find(piece[at : m.start()])
                part.append(self.special[m[0]])
                at = m.end()
            parts[piece] = part + find(piece[at:] if at else piece)
            fresh.update((w, None) for w in parts[piece] if w.__class__ is str and w not in known)
        words = [w for w in fresh if w]
        known.update(zip(words, self._learn(words), strict=True))
        for piece, part in parts.items():
            known[piece] = b"".join(known[w] if w.__class__ is str else np.array([w], "<u4").tobytes() for w in part)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        if len(self._new) > CACHE:
            self._old, self._new = self._new, {}
        cut = [pieces_of(t) for t in texts]
        new, old, missing = self._new, self._old, []
        for piece in set().union(*cut):
            if piece not in new:
                if (ids := old.get(piece)) is None:
                    missing.append(piece)
                else:
                    new[piece] = ids
        self._encode_pieces(missing)
        return [b"".join(map(new.__getitem__, c)) for c in cut]

    def forget(self) -> None:
        self._new, self._old = {}, {}

    def decode(self, ids: bytes) -> str:
        return self.decoded([ids])[0]

    def decoded(self, rows: list[bytes]) -> list[str]:
        """The text of each row of ids."""
        tokens = np.frombuffer(b"".join(rows), "<u4").astype(np.int64)
        ends = np.cumsum([0, *(len(r) // 4 for r in rows)])
        text, cuts = self.spelled(tokens).tobytes(), np.concatenate([[0], np.cumsum(self._sizes[tokens])])[ends].tolist()
        return [text[a:b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:], strict=False)]


def _sums(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _scale(len(data)), out=out[1:])
    return out


def _between(sums: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix((sums[b] - sums[a]) * _unscale(len(sums))[a] + (b - a).astype(np.uint64))


def _spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return _between(_sums(data), starts, ends)


_BASE = 0x9E6C63D0876A9A63
_tables: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    if len(_tables.get(base, ())) < n:
        _tables[base] = powers(base, max(n, 1 << 16))
    return _tables[base][:n]


def _scale(n: int) -> np.ndarray:
    return _power_table(_BASE, n)


def _unscale(n: int) -> np.ndarray:
    return _power_table(pow(_BASE, -1, 2**64), n)


def pieces_of(text: str) -> list[str]:
    """The text cut before each space that stands between two characters that are not blank."""
    if not text:
        return []
    if not _LOOSE.search(text) and _MARK not in text:
        return text.replace(" ", _MARK + " ").split(_MARK)
    first, *rest = text.split(" ")
    out = [first]
    for part in rest:
        if out[-1] and part and not out[-1][-1].isspace() and not part[0].isspace():
            out.append(" " + part)
        else:
            out[-1] += " " + part
    return out


_loaded: dict[str, Bpe] = {}


def loaded(path: str) -> Bpe:
    """One instance per worker process and file."""
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def _parts(sizes: list[int]):
    """Ranges of rows of about PART characters or bytes, a longer row alone."""
    at = size = 0
    for i, n in enumerate(sizes):
        if size and size + n > PART:
            yield at, i
            at, size = i, 0
        size += n
    yield at, len(sizes)


def _in_parts(bpe: Bpe, texts: list[str]) -> list[bytes]:
    return [ids for a, b in _parts([len(t) for t in texts]) for ids in bpe.encode(texts[a:b])]


def _decoded_in_parts(bpe: Bpe, rows: list[bytes]) -> list[str]:
    return [text for a, b in _parts([len(r) for r in rows]) for text in bpe.decoded(rows[a:b])]


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """doc_id, n_tokens and ids (binary, little-endian unsigned 32-bit) of each row; with `decoded` also the text that
    decoding those ids gives. The file must exist on every node."""

    def run(batches):
        bpe = loaded(vocabulary)
        for batch in batches:
            ids = _in_parts(bpe, [t or "" for t in batch.column(1).to_pylist()])
            columns = {"doc_id": batch.column(0), "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()), "ids": pa.array(ids, pa.binary())}
            if decoded:
                columns["decoded"] = pa.array(_decoded_in_parts(bpe, ids), pa.string())
            yield pa.RecordBatch.from_pydict(columns)
            del ids, columns
        bpe.forget()
        tidy()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary" + ", decoded string" * decoded)


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """The rows of `encode` with their text decoded from the ids (null ids: null)."""

    def run(batches):
        bpe = loaded(vocabulary)
        for batch in batches:
            ids = batch.column(2).to_pylist()
            text = [None if x is None else t for x, t in zip(ids, _decoded_in_parts(bpe, [x or b"" for x in ids]), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary, decoded string")
