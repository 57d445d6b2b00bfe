"""Operator 12: a Merkle manifest of a table, with a proof for every row.

A leaf is the SHA-256 of a row's fields, each with its length before it (`-` for null). The leaves of a language ascend
by doc_id; every two neighbours become the hash of both (a last one alone the hash of itself) until one node is left, the
language's subroot; the subroots, ordered by language, become the root in the same way.

The tree is built of blocks: `BLOCK` neighbours are one ordered array, whose levels collapse by `sequence`, `transform`,
`slice` and `aggregate` inside one row. The blocks' roots are the nodes of the next tier, in blocks again, so a tree of any size takes
log_BLOCK tiers. No task holds more than one block of a language at a time, and a language of a third of all rows is as
many blocks as it needs: leaves are numbered by a range partitioning that is written with each row's place.

Proofs come down the same tiers: a block's row meets the path from its own root to the top, then its nodes are unfolded
and get their siblings inside the block in front. So the wide join is one row a block, never one a leaf.

Defined cases: null languages are a language of their own, the first; null ids come first in theirs; rows that repeat an
id ascend by their leaf, and equal rows each are a leaf; a null or empty text is a leaf as any other (`-` and `0:`); an
empty table has no leaves and no rows. A row without id is never tampered with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.llm.common import written

BLOCK_BITS = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def hashed(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def encoded(value: Column) -> Column:
    """A field as the leaf takes it: its length in bytes, a colon, the value; `-` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(docs: DataFrame, tampered: Column | None = None, changed: str = "n_chars", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """doc_id, lang, leaf and bad: the leaf after `changed` has grown by one where tampered (the same leaf elsewhere)."""

    def leaf(more: int) -> Column:
        of = lambda name: F.col(name).cast("decimal(38,0)") + more if more and name == changed else F.col(name)
        return hashed(*(encoded(of(name)) for name in fields))

    bad = F.when(tampered, leaf(1)) if tampered is not None else F.lit(None).cast("string")
    return docs.select("doc_id", "lang", leaf(0).alias("leaf"), bad.alias("bad"))


def placed(rows: DataFrame, group: Column, order: list[str]) -> DataFrame:
    """rows with group, pos (their place in their group by order, from 0) and n (rows of their group).

    A row's place is what it is in its partition and what the partitions before hold of its group: a count a partition and
    group. Equal rows are spread over partitions by the place where they were read.
    """
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    keyed = rows.select(group.alias("group"), "*").withColumn("tie", F.monotonically_increasing_id())
    keyed = keyed.repartitionByRange(parts, "group", *order, "tie").sortWithinPartitions("group", *order, "tie").drop("tie")
    keyed = written(keyed.withColumn("place", F.monotonically_increasing_id()).withColumn("part", F.shiftright("place", 33)), "merkle-placed")
    counts = keyed.groupBy(F.col("group").alias("g"), F.col("part").alias("p")).agg(F.count(F.lit(1)).alias("rows"), F.min("place").alias("first"))
    all_ = Window.partitionBy("g")  # a row a partition that the group reaches into
    before = F.coalesce(F.sum("rows").over(all_.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = written(counts.select("g", "p", "first", before.alias("before"), F.sum("rows").over(all_).alias("n")), "merkle-counts")
    found = keyed.join(counts, (F.col("part") == F.col("p")) & F.col("group").eqNullSafe(F.col("g")))
    return found.withColumn("pos", F.col("before") + F.col("place") - F.col("first")).drop("place", "part", "g", "p", "first", "before")


def _up(level: Column) -> Column:
    """The level above: a hash of every two nodes, of a last one alone."""
    pairs = F.sequence(F.lit(0), F.floor((F.size(level) - 1) / 2).cast("int"))
    return F.transform(pairs, lambda i: hashed(F.array_join(F.slice(level, i * 2 + 1, 2), "")))


def _height(n: Column) -> Column:
    """Levels above n nodes until one is left."""
    return F.when(n <= 1, 0).otherwise(F.length(F.bin(n - 1))).cast("int")


def _blocks(nodes: DataFrame, keep: list[str], bits: int) -> DataFrame:
    """group, block, n, height, rows (the kept columns in order) and levels of nodes group, pos, n, node."""
    listed = nodes.groupBy("group", F.shiftright("pos", bits).alias("block")).agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "node", *keep))).alias("rows"))
    # all blocks of a group have all levels of a block where there are several
    listed = listed.withColumn("height", F.when(F.col("n") > 1 << bits, bits).otherwise(_height(F.col("n"))))
    steps = F.when(F.col("height") > 0, F.sequence(F.lit(1), F.col("height"))).otherwise(F.array().cast("array<int>"))
    levels = F.aggregate(steps, F.array(F.col("rows.node")), lambda acc, _: F.concat(acc, F.array(_up(F.element_at(acc, -1)))))
    return written(listed.withColumn("levels", levels), "merkle-blocks")


def _tiers(nodes: DataFrame, keep: list[str], bits: int) -> list[DataFrame]:
    """Tables of blocks from the nodes up; the last has one block a group."""
    most, tiers = nodes.agg(F.max("n")).first()[0] or 0, []
    while True:
        tiers.append(_blocks(nodes, keep if not tiers else [], bits))
        if most <= 1 << bits:
            return tiers
        most = -(-most // (1 << bits))
        above = F.shiftright(F.col("n") - 1, bits) + 1
        nodes = tiers[-1].select("group", F.col("block").alias("pos"), above.alias("n"), F.element_at(F.element_at("levels", -1), 1).alias("node"))


def _unfolded(blocks: DataFrame, keep: list[str]) -> DataFrame:
    """group, pos, node, the kept columns, the roots that the block knows of, and path: the siblings from each node up, those
    above the block (path_above) last. A level without sibling is a null sibling."""

    def siblings(i: Column) -> Column:
        def at(j: Column) -> Column:
            mine = F.call_function("shiftright", i, j)
            level = F.get(F.col("levels"), j)
            return F.struct((mine % 2 == 1).alias("left"), F.get(level, mine.bitwiseXOR(F.lit(1))).alias("sibling"))

        steps = F.when(F.col("height") > 0, F.sequence(F.lit(0), F.col("height") - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(steps, at)

    nodes = F.transform("rows", lambda row, i: F.struct(row.alias("row"), siblings(i).alias("own")))
    tops = [c for c in ("root", "subroot") if c in blocks.columns]
    found = blocks.select("group", "path_above", *tops, F.explode(nodes).alias("x"))
    return found.select("group", *tops, "x.row.pos", "x.row.node", *(F.col(f"x.row.{c}") for c in keep), F.concat("x.own", "path_above").alias("path"))


_NO_PATH = "array<struct<left: boolean, sibling: string>>"


def _down(tiers: list[DataFrame], keep: list[str], top: DataFrame) -> DataFrame:
    """The nodes of the lowest tier with their paths; top: what the blocks of the highest tier get (path_above, root and so on)."""
    for i, tier in reversed(list(enumerate(tiers))):
        found = _unfolded(top, keep if i == 0 else [])
        if i == 0:
            break
        up = found.select(F.col("group").alias("g"), F.col("pos").alias("p"), F.col("path").alias("path_above"), *(c for c in ("root", "subroot") if c in found.columns))
        below = tiers[i - 1]
        top = below.join(up, below["group"].eqNullSafe(up["g"]) & (below["block"] == up["p"])).drop("g", "p")
    return found


def proofs(rows: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """doc_id, leaf, subroot, root, bad and path (left, sibling) of rows doc_id, lang, leaf, bad."""
    nodes = placed(written(rows, "merkle-leaves"), F.col("lang"), ["doc_id", "leaf"]).withColumnRenamed("leaf", "node")
    tiers = _tiers(nodes.select("group", "pos", "n", "node", "doc_id", "bad"), ["doc_id", "bad"], bits)
    subroots = tiers[-1].select("group", F.element_at(F.element_at("levels", -1), 1).alias("node"))
    ordered = placed(subroots.select(F.col("group").alias("name"), "node"), F.lit(0), ["name"])
    upper = _tiers(ordered.select("group", "pos", "n", "node", "name"), ["name"], bits)
    root = F.element_at(F.element_at("levels", -1), 1)
    names = _down(upper, ["name"], upper[-1].select("*", F.array().cast(_NO_PATH).alias("path_above"), root.alias("root")))
    names = names.select(F.col("name").alias("g"), F.col("node").alias("subroot"), "root", F.col("path").alias("path_above"))
    last = tiers[-1]  # one block a language
    top = last.join(names, last["group"].eqNullSafe(names["g"])).drop("g")
    found = _down(tiers, ["doc_id", "bad"], top)
    return found.select("doc_id", F.col("node").alias("leaf"), "subroot", "root", "bad", "path")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its way give."""

    def step(acc: Column, at: Column) -> Column:
        sibling = at["sibling"]
        return hashed(F.when(sibling.isNull(), acc).when(at["left"], F.concat(sibling, acc)).otherwise(F.concat(acc, sibling)))

    return F.aggregate(path, leaf, step)


def proof_digest(path: Column) -> Column:
    return hashed(F.array_join(F.transform(path, lambda at: at["sibling"]), ""))


def manifest(docs: DataFrame, tampered: Column | None = None, bits: int = BLOCK_BITS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified - one row per row of docs. folded_root is worked out
    of the leaf as tampered with (else the leaf itself) and the siblings of the untampered tree."""
    found = proofs(leaves(docs, tampered), bits)
    root = folded(F.coalesce("bad", "leaf"), F.col("path"))
    found = found.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), root.alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def every_seventh(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 == 0, F.lit(False))


#: SQL for the unsigned crc32 of a list of bytes; crc.t is its table of 256.
CRC_TABLE = "crc AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"


def crc_sql(codes: str) -> str:
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {codes}), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295)"


def _field_sql(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}::VARCHAR, '-')"


def _leaf_sql(chars: str) -> str:
    return "sha256(" + " || ".join(_field_sql(c) for c in ("doc_id", "source", "lang", chars, "text")) + ")"


_BAD = f"CASE WHEN {crc_sql("list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)")} % 7 = 0 THEN {_leaf_sql('(n_chars + 1)')} ELSE {_leaf_sql('n_chars')} END"

ORACLE = f"""
WITH RECURSIVE {CRC_TABLE},
d AS (SELECT doc_id, lang, {_leaf_sql("n_chars")} AS leaf, {_BAD} AS bad FROM documents, crc),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id, leaf) - 1 AS pos FROM d),
a AS (SELECT lang, 0 AS level, pos, leaf AS node, count(*) OVER (PARTITION BY lang) AS n FROM p
UNION ALL SELECT lang, level + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos)), (max(n) + 1) // 2 FROM a WHERE n > 1 GROUP BY lang, level, pos // 2),
s AS (SELECT lang, node AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos FROM a WHERE n = 1),
b AS (SELECT 0 AS level, pos, subroot AS node, count(*) OVER () AS n FROM s
UNION ALL SELECT level + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos)), (max(n) + 1) // 2 FROM b WHERE n > 1 GROUP BY level, pos // 2),
w AS (SELECT p.doc_id, p.leaf, p.bad, p.pos AS i, s.subroot, s.pos AS j, p.lang, (SELECT node FROM b WHERE n = 1) AS root FROM p JOIN s ON s.lang IS NOT DISTINCT FROM p.lang),
u AS (SELECT w.lang, w.i, a.level, (w.i >> a.level) & 1 AS odd, o.node FROM w JOIN a ON a.lang IS NOT DISTINCT FROM w.lang AND a.n > 1 AND a.pos = w.i >> a.level LEFT JOIN a o ON o.lang IS NOT DISTINCT FROM w.lang AND o.level = a.level AND o.pos = xor(a.pos, 1)
UNION ALL SELECT w.lang, w.i, 1000 + b.level, (w.j >> b.level) & 1, o.node FROM w JOIN b ON b.n > 1 AND b.pos = w.j >> b.level LEFT JOIN b o ON o.level = b.level AND o.pos = xor(b.pos, 1)),
g AS (SELECT lang, i, string_agg(node, '' ORDER BY level) AS proof, list({{'odd': odd, 'node': node}} ORDER BY level) AS path FROM u GROUP BY lang, i),
f AS (SELECT w.*, coalesce(proof, '') AS proof, list_reduce(list_concat([{{'odd': 0::BIGINT, 'node': bad}}], coalesce(path, [])), lambda x, y: {{'odd': 0::BIGINT, 'node': sha256(CASE WHEN y.node IS NULL THEN x.node WHEN y.odd = 1 THEN y.node || x.node ELSE x.node || y.node END)}}).node AS folded FROM w LEFT JOIN g ON g.i = w.i AND g.lang IS NOT DISTINCT FROM w.lang)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified FROM f
"""
