"""Confirmed links between shingle sets that meet in buckets: what the near-duplicate operators share.

Documents with equal sets are one vertex. A bucket is a key under which vertices meet. Each vertex is first compared with
its buckets' most central ones (those that share most buckets with others: the original among its copies). Where a bucket still
holds vertices that this left apart, those outside its largest class are compared with all others of the bucket in blocks
of `BLOCK` against `BLOCK` vertices (fewer where their sets are long: a block has about `BLOCK_BYTES`), and only links that
join two classes leave a block pair. Buckets with the same vertices are one there, and a pair that meets in several is
looked at in the first. Blocks are first made of bitmaps, a sixteenth of the sets: each element flips a bit, so two bitmaps differ in no
more bits than the sets differ in elements, and what has no partner within that bound needs no set. So the result has every component that the confirmed links of all bucket pairs would give, while
buckets of near-copies cost about one comparison a vertex and no task gathers a bucket.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import split_join, written
from quirefold.llm.components import components
from quirefold.llm.words import U, buffer_of, chunks, grams, hashes, split

BLOCK, BLOCK_BYTES, SLICE = 128, 4 << 20, 1 << 13


def shingle_sets(column: pa.Array, size: int):
    """The sorted distinct shingle hashes of each text."""
    data, offsets = buffer_of(column)
    for a, b in chunks(offsets):
        words = split(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        h = hashes(words, lower=True)
        g = grams(h, size)
        for start, n in zip(words.first[:-1].tolist(), words.sizes.tolist(), strict=True):
            if n >= size:
                yield np.unique(g[start : start + n - size + 1])
            elif n:
                yield grams(h[start : start + n], n) + U(n)
            else:
                yield np.zeros(0, np.uint64)


def bitmap(values: np.ndarray) -> np.ndarray:
    """Words of 64 bits, four bits to eight an element: every element flips the one that its hash names. Sets of another length
    range have bitmaps of half or twice the width; a wide one folds into a narrow one."""
    bits = max(4 << (len(values) - 1).bit_length(), 64) if len(values) else 64
    flips = np.bincount((values & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").view(np.uint64)


def vertex_of(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def text_digest(text: Column) -> Column:
    """What tells the texts of one id, or of null ids, apart."""
    return F.unhex(F.md5(text.cast("binary")))


def vertices_of(rows: DataFrame, *more: Column) -> DataFrame:
    """vertex, size, n (rows of that set) and first (unknown, id, digest: the row that stands for it) of rows doc_id, digest,
    n_shingles, vertex."""
    row = F.struct(F.col("doc_id").isNull().alias("unknown"), F.col("doc_id").alias("id"), "digest")
    return rows.where("n_shingles > 0").groupBy("vertex").agg(F.first("n_shingles").alias("size"), F.min(row).alias("first"), F.count(F.lit(1)).alias("n"), *more)


def members_of(placed: DataFrame) -> DataFrame:
    """vertex, size, key and n (of the bucket) of rows vertex, size, key whose bucket has several."""
    shared = placed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return split_join(placed, shared, "key")


def named(rows: DataFrame, vertices: DataFrame, links: DataFrame | None) -> DataFrame:
    """rows with n and first: of the row that their component leaves."""
    names = vertices.select("vertex", "first", "n")
    if links is not None and not links.isEmpty():
        roots = components(links).select(F.col("node").alias("vertex"), "root")
        names = names.join(roots, "vertex", "left").withColumn("root", F.coalesce("root", "vertex"))
        least = names.groupBy("root").agg(F.min("first").alias("name"))
        names = split_join(names, least, "root").select("vertex", F.col("name").alias("first"), "n")
    return rows.join(names, "vertex", "left")


def sets_of(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """vertex, members (the set) and bitmap of each of wanted (vertex, id, digest: a row of docs that has it).

    A row is found by its id and its text's digest, so that rows that share an id, or have none, meet their own vertex only.
    """

    def run(batches):
        for batch in batches:
            sets = list(shingle_sets(batch.column(0), size))
            columns = (pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([bitmap(s).tobytes() for s in sets], pa.binary()))
            yield pa.RecordBatch.from_arrays([batch.column(1).cast(pa.binary()), *columns], ["vertex", "members", "bitmap"])

    known = docs.select("doc_id", "text", text_digest(F.col("text")).alias("own"))
    found = known.join(wanted, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("own") == F.col("digest")))
    return found.select("text", "vertex").mapInArrow(run, "vertex binary, members binary, bitmap binary").dropDuplicates(["vertex"])


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True)) if 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)) else 0
    return 100 * both >= percent * (len(a) + len(b) - both)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs u, v whose full sets are as similar as asked."""

    def run(batches):
        for batch in batches:
            a, b = ([np.frombuffer(x, np.uint64) for x in batch.column(i).to_pylist()] for i in (2, 3))
            keep = pa.array([_linked(x, y, percent) for x, y in zip(a, b, strict=True)], pa.bool_())
            yield batch.select(["u", "v"]).filter(keep)

    left = sets.select(F.col("vertex").alias("u"), F.col("members").alias("a"))
    right = sets.select(F.col("vertex").alias("v"), F.col("members").alias("b"))
    return pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b").mapInArrow(run, "u binary, v binary")


@dataclass
class Block:
    """Some vertices of a bucket, in arrays that one binary value holds."""

    vertex: np.ndarray  #: n x 2, as all that follow for vertices and roots: 16 bytes in two integers
    root: np.ndarray
    met: np.ndarray  #: how many keys each has
    sizes: np.ndarray
    lens: np.ndarray  #: words of each one's members
    keys: np.ndarray  #: all keys, one vertex after the other
    members: np.ndarray  #: all sets, or all bitmaps

    def pack(self) -> bytes:
        head = np.array([len(self.sizes), len(self.keys)], np.int64)
        return b"".join(x.tobytes() for x in (head, self.vertex, self.root, self.met, self.sizes, self.lens, self.keys, self.members))

    @classmethod
    def unpack(cls, data: bytes) -> Block:
        words = np.frombuffer(data, np.uint64)
        n, keys = words[:2].astype(np.int64)
        a, b, c, d, e, f, g = np.cumsum([2, 2 * n, 2 * n, n, n, n, keys]).astype(int)
        return cls(words[a:b].reshape(n, 2), words[b:c].reshape(n, 2), *(words[x:y].view(np.int64) for x, y in ((c, d), (d, e), (e, f), (f, g))), words[g:])

    def _cut(self, values: np.ndarray, sizes: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
        ends = np.cumsum(sizes)
        return [values[ends[i] - sizes[i] : ends[i]] for i in rows]

    def sets(self, rows: np.ndarray) -> list[np.ndarray]:
        return self._cut(self.members, self.lens, rows)

    def keys_of(self, rows: np.ndarray) -> list[np.ndarray]:
        return self._cut(self.keys, self.met, rows)

    def only(self, rows: np.ndarray) -> Block:
        sets, keys = self.sets(rows), self.keys_of(rows)
        joined = lambda parts, like: np.concatenate(parts) if parts else like[:0]
        return Block(self.vertex[rows], self.root[rows], self.met[rows], self.sizes[rows], self.lens[rows], joined(keys, self.keys), joined(sets, self.members))


def _packed(rows: DataFrame) -> DataFrame:
    """key, some, others and blocks of rows key, largest, a list of at most about BLOCK vertices, and the number of the
    bucket's blocks."""

    def run(batches):
        for batch in batches:
            keys, largest, lists = batch.column(0), batch.column(1).to_pylist(), batch.column(2)
            some, others = [], []
            for i in range(batch.num_rows):
                part = lists[i].values
                column = lambda name: part.field(name).to_pylist()  # noqa: B023, E731
                members, met = column("members"), column("keys")
                block = Block(
                    *(np.frombuffer(b"".join(column(c)), np.uint64).reshape(-1, 2) for c in ("vertex", "root")),
                    np.array([len(k) for k in met], np.int64), np.array(column("size"), np.int64), np.array([len(x) // 8 for x in members], np.int64),
                    np.array([k for ks in met for k in ks], np.int64), np.frombuffer(b"".join(members), np.uint64),
                )
                outside = np.flatnonzero((block.root != np.frombuffer(largest[i], np.uint64)).any(axis=1))
                some.append(block.only(outside).pack() if len(outside) else None)
                others.append(block.pack())
            yield pa.RecordBatch.from_arrays([keys, pa.array(some, pa.binary()), pa.array(others, pa.binary()), batch.column(3)], ["key", "some", "others", "blocks"])

    return rows.mapInArrow(run, "key long, some binary, others binary, blocks long")


def _met(apart: DataFrame, payload: DataFrame) -> DataFrame:
    """key, some (outside the largest class) and others: the pairs of blocks of each bucket, with the payload (vertex, members)."""
    keys = apart.groupBy("vertex").agg(F.collect_list("key").alias("keys"))
    listed = apart.withColumn("block", F.pmod(F.xxhash64("vertex"), "blocks")).join(keys, "vertex").join(payload, "vertex")
    listed = listed.groupBy("key", "block").agg(F.first("largest").alias("largest"), F.collect_list(F.struct("vertex", "root", "size", "keys", "members")).alias("list"), F.first("blocks").alias("blocks"))
    blocks = written(_packed(listed.select("key", "largest", "list", "blocks")), "links-blocks")
    met = blocks.where("blocks = 1 AND some IS NOT NULL").select("key", "some", "others")
    large = blocks.where("blocks > 1")
    if large.isEmpty():
        return met
    return met.unionByName(large.where("some IS NOT NULL").select("key", "some").join(large.select("key", "others"), "key"))


def _first_met(key: int, some: Block, others: Block, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of unlike classes whose sizes allow a link, and that meet in no bucket before this one."""
    n, m = some.sizes, others.sizes
    apart = (some.root[:, None, :] != others.root).any(axis=2)
    i, j = np.nonzero(apart & (100 * np.minimum(n[:, None], m) >= percent * np.maximum(n[:, None], m)))
    if len(i):
        rows, r = np.unique(i, return_inverse=True)
        cols, c = np.unique(j, return_inverse=True)
        before = _common([k[k < key] for k in some.keys_of(rows)], [k[k < key] for k in others.keys_of(cols)])[r, c]
        i, j = i[before == 0], j[before == 0]
    return i, j


def _folded(words: np.ndarray, width: int) -> np.ndarray:
    while len(words) > width:
        words = words[: len(words) // 2] ^ words[len(words) // 2 :]
    return words


def _possible(key: int, some: Block, others: Block, percent: int) -> set[bytes]:
    """The vertices of two blocks of bitmaps that may have a link to another class."""
    i, j = _first_met(key, some, others, percent)
    out: set[bytes] = set()
    width = np.minimum(some.lens[i], others.lens[j])
    for w in np.unique(width).tolist():
        a, b = i[width == w], j[width == w]
        rows, r = np.unique(a, return_inverse=True)
        cols, c = np.unique(b, return_inverse=True)
        x, y = np.array([_folded(v, w) for v in some.sets(rows)]), np.array([_folded(v, w) for v in others.sets(cols)])
        step = max(1, (1 << 20) // w)
        for low in range(0, len(a), step):
            s = slice(low, low + step)
            unlike = np.bitwise_count(x[r[s]] ^ y[c[s]]).sum(axis=1, dtype=np.int64)
            total = some.sizes[a[s]] + others.sizes[b[s]]
            good = 100 * (total - unlike) >= percent * (total + unlike)
            out.update(some.vertex[k].tobytes() for k in np.unique(a[s][good]).tolist())
            out.update(others.vertex[o].tobytes() for o in np.unique(b[s][good]).tolist())
    return out


def _possible_links(met: DataFrame, percent: int) -> DataFrame:
    """key, vertex of what its blocks' bitmaps leave."""

    def run(batches):
        for batch in batches:
            for key, some, others in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                left = sorted(_possible(key, Block.unpack(some), Block.unpack(others), percent))
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(left), pa.int64()), pa.array(left, pa.binary())], ["key", "vertex"])

    return met.mapInArrow(run, "key long, vertex binary").distinct()


def _block_links(met: DataFrame, percent: int) -> DataFrame:
    """Links between classes from pairs of blocks of sets."""

    def run(batches):
        for batch in batches:
            out: list[tuple[bytes, bytes]] = []
            for key, some, others in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                out += _join_blocks(key, Block.unpack(some), Block.unpack(others), percent)
            yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in out], pa.binary()), pa.array([v for _, v in out], pa.binary())], ["u", "v"])

    return met.mapInArrow(run, "u binary, v binary").distinct()


def _common(xs: list[np.ndarray], ys: list[np.ndarray]) -> np.ndarray:
    """How many values each of xs has in common with each of ys: products of 0/1 matrices over slices of the values."""
    both = np.concatenate([*xs, *ys])
    values, place = np.unique(both, return_inverse=True)
    row = np.repeat(np.arange(len(xs) + len(ys)), [len(v) for v in (*xs, *ys)])
    # a value that only one set holds is common to none
    held = np.flatnonzero(np.bincount(place, minlength=1) > 1)
    new = np.full(len(values), -1)
    new[held] = np.arange(len(held))
    place, row = new[place][new[place] >= 0], row[new[place] >= 0]
    out = np.zeros((len(xs), len(ys)), np.float32)
    for low in range(0, len(held), SLICE):
        some = (place >= low) & (place < low + SLICE)
        grid = np.zeros((len(xs) + len(ys), min(SLICE, len(held) - low)), np.float32)
        grid[row[some], place[some] - low] = 1
        out += grid[: len(xs)] @ grid[len(xs) :].T
    return out.astype(np.int64)


def _join_blocks(key: int, some: Block, others: Block, percent: int) -> list[tuple[bytes, bytes]]:
    i, j = _first_met(key, some, others, percent)
    if not len(i):
        return []
    rows, r = np.unique(i, return_inverse=True)
    cols, c = np.unique(j, return_inverse=True)
    both = _common(some.sets(rows), others.sets(cols))[r, c]
    good = 100 * both >= percent * (some.sizes[i] + others.sizes[j] - both)
    parent: dict[bytes, bytes] = {}

    def find(x: bytes) -> bytes:
        while (up := parent.get(x, x)) != x:
            x = up
        return x

    out = []
    for k, o in zip(i[good].tolist(), j[good].tolist(), strict=True):
        x, y = find(some.root[k].tobytes()), find(others.root[o].tobytes())
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((some.vertex[k].tobytes(), others.vertex[o].tobytes()))
    return out


def _left_apart(members: DataFrame, links: DataFrame) -> DataFrame:
    """key, vertex, root, largest and blocks of the buckets that still hold several classes; of buckets with the same
    vertices one."""
    # classes so far are hubs and what links to them
    up = links.groupBy(F.col("u").alias("vertex")).agg(F.min("v").alias("root"))
    up = split_join(up, up.select(F.col("vertex").alias("root"), F.col("root").alias("next")), "root", "left").select("vertex", F.coalesce("next", "root").alias("root"))
    rest = members.where("n > 2").select("key", "vertex", "size").join(up, "vertex", "left").withColumn("root", F.coalesce("root", "vertex"))
    content = lambda seed: F.sum(F.xxhash64(F.lit(seed), "vertex").cast("decimal(38,0)"))
    by_root = rest.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), content(1).alias("c1"), content(2).alias("c2"))
    blocks = F.greatest(F.ceil(F.sum("n") / BLOCK), F.ceil(F.sum("size") * 8 / BLOCK_BYTES)).cast("long")
    several = by_root.groupBy("key").agg(F.count(F.lit(1)).alias("roots"), blocks.alias("blocks"), F.max_by("root", F.struct("n", "root")).alias("largest"), F.sum("n").alias("n"), F.sum("c1").alias("c1"), F.sum("c2").alias("c2")).where("roots > 1")
    one = several.groupBy("n", "c1", "c2").agg(F.min(F.struct("key", "blocks", "largest")).alias("one")).select("one.*")
    return written(split_join(rest, one, "key"), "links-apart")


def confirmed_links(docs: DataFrame, vertices: DataFrame, members: DataFrame, percent: int, size: int) -> DataFrame | None:
    """Confirmed links u, v that have the same components as all confirmed links of pairs in a bucket; None for none.

    docs: doc_id, text; vertices as of vertices_of; members as of members_of; size: words of a shingle.
    """
    central = members.groupBy("vertex").agg(F.sum("n").alias("met"))
    ranked = split_join(members, central, "vertex")
    hubs = ranked.groupBy("key").agg(F.max(F.struct("met", "vertex")).alias("hub")).select("key", F.col("hub.vertex").alias("v"))
    pairs = written(split_join(members, hubs, "key").where("vertex <> v").select(F.col("vertex").alias("u"), "v").distinct(), "links-pairs")
    if pairs.isEmpty():
        return None
    wanted = vertices.join(members.select("vertex").distinct(), "vertex", "left_semi").select("vertex", F.col("first.id").alias("id"), F.col("first.digest").alias("digest"))
    sets = written(sets_of(docs, wanted, size), "links-sets")
    links = written(confirmed(pairs, sets, percent), "links-first")
    apart = _left_apart(members, links)
    possible = written(_possible_links(_met(apart, sets.select("vertex", F.col("bitmap").alias("members"))), percent), "links-possible")
    if possible.isEmpty():
        return links
    more = _block_links(_met(apart.join(possible, ["key", "vertex"], "left_semi"), sets.select("vertex", "members")), percent)
    return links.unionByName(written(more, "links-more"))
