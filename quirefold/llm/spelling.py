"""Operator 11: spelling variants, by forward and backward minimal acyclic automata.

Words are near when they differ by exactly one inserted, deleted or replaced letter. Cut a word in halves: whatever it is
near to agrees with one half exactly. So a forward automaton matches the first half and completes the second with one
error, a backward automaton (of the words reversed) matches the second half and completes the first (Mihov and Schulz,
"Fast Approximate Search in Large Dictionaries", 2004). The automata are minimal, and their edges say how many words lie
before them, so that a path adds up to its word's number: a perfect hash, by which counts are looked up. What both
directions find is left to the forward one, which is told by the agreement of the first half.

Every word asks under its own halves and answers under the halves of words one letter shorter and longer, two rows a
direction. Rows are partitioned by half; a task builds both automata of the words it got, and answers all its questions
side by side in arrays. A half that very many words share is split into blocks of words, each of which gets all of its
questions. A task hands on one row a question: how many words are near and which is the most frequent; pairs are never
written.

Defined cases: a null text has no runs; a null doc_id is an empty text before the colon; rows that repeat an id or a text
count each; a run of any length is one word (an automaton takes about 60 bytes a letter, and only words whose half some
other word shares get into one); of near words with equal counts the first in code-point order is the form; an empty
table has no words.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import split_join, tidy, written
from quirefold.llm.merkle import CRC_TABLE, crc_sql
from quirefold.llm.words import U, mix

MODULUS, LETTERS, LEAST = 97, 5, 3
#: Words of one half that a block holds; letters that a task holds; questions that are followed at once; words tallied at once.
BLOCK, TASK, ASKED, TALLY = 1 << 16, 4 << 20, 1 << 12, 1 << 16
_PIECE = 1 << 20
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), 0xC3]] = True


def runs(text: bytes) -> Iterator[list[bytes]]:
    """The maximal runs of letters A-Z, a-z and U+00C0-U+00FF of UTF-8 text, A-Z lower-cased, in pieces of about a megabyte.

    Each letter above ASCII is byte 0xC3 and one more, and no other character starts with that byte.
    """
    data = np.frombuffer(text, np.uint8)
    keep = _LETTER[data]
    keep[1:] |= data[:-1] == 0xC3
    gaps = None
    at = 0
    while at < len(data):
        to = min(at + _PIECE, len(data))
        if to < len(data) and keep[to]:
            gaps = np.flatnonzero(~keep) if gaps is None else gaps
            after = np.searchsorted(gaps, to)
            to = int(gaps[after]) if after < len(gaps) else len(data)
        yield np.where(keep[at:to], data[at:to], 32).astype(np.uint8).tobytes().lower().split()
        at = to


def respelled(word: bytes, h: int) -> bytes:
    """The word without its code point h % length."""
    text = word.decode()
    at = h % len(text)
    return (text[:at] + text[at + 1 :]).encode()


def _tallied(batches, modulus: int, letters: int) -> Iterator[pa.RecordBatch]:
    tally: Counter = Counter()

    def out() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(tally.keys(), pa.binary()).cast(pa.string()), pa.array(tally.values(), pa.int64())], ["word", "n"])
        tally.clear()
        return batch

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
            found: Counter = Counter()
            for piece in runs(text.as_py() or b""):
                found.update(piece)
            start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
            for word, n in found.items():
                if len(word) >= letters:
                    h = zlib.crc32(word, start)
                    if h % modulus == 0:
                        word = respelled(word, h)
                    if len(word) - word.count(b"\xc3") >= letters:
                        tally[word] += n
            if len(tally) > TALLY:
                yield out()
    if tally:
        yield out()
    tidy()


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = MODULUS, letters: int = LETTERS, least: int = LEAST) -> DataFrame:
    """word and n: the words of at least so many letters and occurrences."""
    rows = docs.select(F.col(id_col).cast("string"), text_col)
    return rows.mapInArrow(lambda batches: _tallied(batches, modulus, letters), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


@dataclass
class Automaton:
    """States, each with its edges in the order of their letters; state 0 is the first."""

    final: np.ndarray
    first: np.ndarray  #: the first edge of each state; one more entry than states
    key: np.ndarray  #: of each edge 256 * state + letter, ascending
    target: np.ndarray
    skip: np.ndarray  #: how many words of the state come before those of the edge

    @classmethod
    def of(cls, words: list[bytes], seed: int = 0) -> Automaton:
        """Of distinct words in order. Their tree is built a letter at a time; states with equal hashes of all that follows
        them become one, and are compared with it, so that no collision merges unlike states."""
        lens = np.array([len(w) for w in words], np.int64)
        flat, starts = np.frombuffer(b"".join(words), np.uint8), np.cumsum(lens) - lens
        act, group = np.arange(len(words)), np.zeros(len(words), np.int64)
        size = int(lens.sum()) + 1
        parent, label = np.zeros(size, np.int32), np.zeros(size, np.uint8)
        count, final = np.zeros(size, np.int32), np.zeros(size, bool)
        count[0], final[0] = len(words), len(words) > 0 and lens[0] == 0
        low, high, depth, levels = 0, 1, 0, [0]
        while True:
            keep = lens[act] > depth
            act, group = act[keep], group[keep]
            if not len(act):
                break
            letter = flat[starts[act] + depth]
            new = np.ones(len(act), bool)
            new[1:] = (group[1:] != group[:-1]) | (letter[1:] != letter[:-1])
            at = np.flatnonzero(new)
            depth += 1
            parent[high : high + len(at)], label[high : high + len(at)] = low + group[at], letter[at]
            count[high : high + len(at)] = np.diff(np.append(at, len(act)))
            final[high : high + len(at)] = lens[act[at]] == depth
            group = np.cumsum(new) - 1
            low, high = high, high + len(at)
            levels.append(low)
        levels.append(high)
        parent, label, count, final = parent[:high], label[:high], count[:high], final[:high]
        right = np.where(final, U(0x9E3779B97F4A7C15), U(seed + 1))
        code = mix((np.arange(256, dtype=np.uint64) + U(seed)) * U(0xD1342543DE82EF95) + U(7))
        for a, b in zip(levels[-2:0:-1], levels[:1:-1], strict=True):
            heads = np.flatnonzero(np.append(True, parent[a + 1 : b] != parent[a : b - 1]))
            right[parent[a:b][heads]] += np.add.reduceat(mix(right[a:b] + code[label[a:b]]), heads)
        _, lead, state = np.unique(right, return_index=True, return_inverse=True)
        # the first state is the tree's root
        order = np.argsort(lead)
        rank = np.empty(len(lead), np.int64)
        rank[order] = np.arange(len(lead))
        lead, state = lead[order], rank[state]
        child = np.searchsorted(parent[1:], np.arange(high + 1)) + 1  # children of a node lie together
        degree = np.diff(child)
        if not cls._same(lead, state, final, degree, child, label):
            return cls.of(words, seed + 1)
        first = np.concatenate([[0], np.cumsum(degree[lead])])
        edge = np.repeat(child[lead] - first[:-1], degree[lead]) + np.arange(first[-1])
        before = np.cumsum(count[edge]) - count[edge]
        skip = before - np.repeat(before[first[:-1][degree[lead] > 0]] - final[lead][degree[lead] > 0], degree[lead][degree[lead] > 0])
        return cls(final[lead], first, np.repeat(np.arange(len(lead)), degree[lead]) * 256 + label[edge], state[edge], skip)

    @staticmethod
    def _same(lead: np.ndarray, state: np.ndarray, final: np.ndarray, degree: np.ndarray, child: np.ndarray, label: np.ndarray) -> bool:
        """Whether each node of the tree has the ending and the edges of the node that stands for it."""
        of = lead[state]
        if (final != final[of]).any() or (degree != degree[of]).any():
            return False
        inner = np.flatnonzero((degree > 0) & (of != np.arange(len(of))))
        n = degree[inner]
        steps = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        mine, its = np.repeat(child[inner], n) + steps, np.repeat(child[of[inner]], n) + steps
        return bool((label[mine] == label[its]).all() and (state[mine] == state[its]).all())

    def step(self, state: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The edge of each state by its letter, and which of them there are."""
        want = state * 256 + letter
        at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
        return at, self.key[at] == want

    def number(self, words: list[bytes]) -> np.ndarray:
        """Each word's place among the automaton's words; -1 for others."""
        out = []
        for word in words:
            state, total = 0, 0
            for letter in word:
                (at,), (hit,) = self.step(np.array([state]), np.array([letter]))
                if not hit:
                    state = -1
                    break
                state, total = int(self.target[at]), total + int(self.skip[at])
            out.append(total if state >= 0 and self.final[state] else -1)
        return np.array(out, np.int64)

    def near(self, asked: list[bytes], exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in asked and numbers of words: of each word asked for those that begin with its first `exact` letters and
        whose rest differs from its rest by one letter; each once."""
        found = [self._near(asked[at : at + ASKED], exact[at : at + ASKED]) for at in range(0, len(asked), ASKED)]
        return (np.concatenate([at + p for at, (p, _) in zip(range(0, len(asked), ASKED), found, strict=True)]), np.concatenate([n for _, n in found])) if found else (np.zeros(0, np.int64),) * 2

    def _near(self, asked: list[bytes], exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        none = np.zeros(0, np.int64)
        if not len(self.key):
            return none, none
        lens = np.array([len(w) for w in asked], np.int64)
        flat, starts = np.frombuffer(b"".join(asked) + b"\0", np.uint8).astype(np.int64), np.cumsum(lens) - lens
        who, state, total, depth = np.arange(len(asked)), np.zeros(len(asked), np.int64), np.zeros(len(asked), np.int64), 0
        wrong: list[tuple[np.ndarray, ...]] = []  # who, place, state, total once the error is made
        while len(who):
            open_ = np.flatnonzero(depth >= exact[who])
            if len(open_):
                w, s, t = who[open_], state[open_], total[open_]
                inside = lens[w] > depth
                wrong.append((w[inside], np.full(inside.sum(), depth + 1), s[inside], t[inside]))  # a letter too many
                n = np.diff(self.first)[s]
                edge = np.repeat(self.first[s] - np.cumsum(n) + n, n) + np.arange(n.sum())
                w, t, wanted = np.repeat(w, n), np.repeat(t, n) + self.skip[edge], np.repeat(np.where(inside, flat[starts[w] + depth], -1), n)
                wrong.append((w, np.full(len(w), depth), self.target[edge], t))  # one is missing
                other = (wanted >= 0) & (self.key[edge] % 256 != wanted)
                wrong.append((w[other], np.full(other.sum(), depth + 1), self.target[edge][other], t[other]))  # another one
            going = np.flatnonzero(lens[who] > depth)
            who, state, total = who[going], state[going], total[going]
            if len(who):
                at, hit = self.step(state, flat[starts[who] + depth])
                who, state, total = who[hit], self.target[at[hit]], total[hit] + self.skip[at[hit]]
            depth += 1
        if not wrong:
            return none, none
        who, place, state, total = (np.concatenate(x) for x in zip(*wrong, strict=True))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(who):
            ended = place == lens[who]
            good = ended & self.final[state]
            done.append((who[good], total[good]))
            who, place, state, total = who[~ended], place[~ended], state[~ended], total[~ended]
            if len(who):
                at, hit = self.step(state, flat[starts[who] + place])
                who, place, state, total = who[hit], place[hit] + 1, self.target[at[hit]], total[hit] + self.skip[at[hit]]
        who, number = (np.concatenate(x) for x in zip(*done, strict=True))
        pairs = np.unique(np.stack([who, number]), axis=1)
        return pairs[0], pairs[1]


def _answers(words: list[bytes], counts: np.ndarray, asked: list[bytes], backward: bool, under: np.ndarray, known: np.ndarray) -> pa.RecordBatch:
    """word, near, best_n and best of each word asked for that is near to some of words, which are distinct and in order.

    under: the half that each word asks under, known: half * words + word of those that answer here; a word that is here
    under another half answers elsewhere.
    """
    if backward:
        order = sorted(range(len(words)), key=lambda i: words[i][::-1])
        automaton, of = Automaton.of([words[i][::-1] for i in order]), np.array(order)
        who, number = automaton.near([w[::-1] for w in asked], np.array([len(w) - len(w) // 2 for w in asked]))
        number = of[number]
        # what agrees in the first half the other direction has found
        heads = [w[: len(w) // 2] for w in asked]
        apart = np.array([not words[n].startswith(heads[w]) for w, n in zip(who.tolist(), number.tolist(), strict=True)], bool)
        who, number = who[apart], number[apart]
    else:
        who, number = Automaton.of(words).near(asked, np.array([len(w) // 2 for w in asked]))
    here = np.isin(under[who] * len(words) + number, known)
    who, number = who[here], number[here]
    best = np.lexsort((number, -counts[number], who))
    who, number = who[best], number[best]
    one, at, n = np.unique(who, return_index=True, return_counts=True)
    text = lambda some: pa.array([w.decode("latin-1") for w in some], pa.string())
    return pa.RecordBatch.from_arrays([text(asked[i] for i in one.tolist()), pa.array(n, pa.int64()), pa.array(counts[number[at]], pa.int64()), text(words[i] for i in number[at].tolist())], ["word", "near", "best_n", "best"])


def _searched(batches) -> Iterator[pa.RecordBatch]:
    """Both directions of a partition's rows: backward, half, asks, answers, word, n. Where a half has one row only, nothing
    is near."""
    table = pa.Table.from_batches(list(batches))
    if not table.num_rows:
        return
    backward, half = table["backward"].to_numpy(), table["half"].to_numpy()
    _, of = np.unique(half, return_inverse=True)
    shared = np.bincount(of)[of] > 1
    for side in (False, True):
        some = table.take(pa.array(np.flatnonzero(shared & (backward == side)))).sort_by([("word", "ascending")])
        if not some.num_rows:
            continue
        words = np.array([w.encode("latin-1") for w in some["word"].to_pylist()], object)  # in code-point order
        asks, answers = some["asks"].to_numpy(), some["answers"].to_numpy()
        _, under = np.unique(some["half"].to_numpy(), return_inverse=True)
        known, at, place = np.unique(words[answers], return_index=True, return_inverse=True)
        asked, first = np.unique(words[asks], return_index=True)
        if len(known) and len(asked):
            yield _answers(known.tolist(), some["n"].to_numpy()[answers][at], asked.tolist(), side, under[asks][first], under[answers] * len(known) + place)
    tidy()


def near_digest(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """word, n_near, form_n and form (of the near word that occurs most) of words word, n that have near words."""
    spark, w, size = words.sparkSession, F.col("word"), F.length("word")
    odd = size % 2
    low = F.floor(size / 2).cast("int")
    head = lambda k: F.substring(w, F.lit(1), k)
    tail = lambda k: F.right(w, k)

    def row(backward: bool, asks: bool, part: Column) -> Column:
        return F.struct(F.lit(backward).alias("backward"), F.xxhash64(F.lit(backward), part).alias("half"), F.lit(asks).alias("asks"))

    # a word of 2k letters answers to first halves of k - 1 and k, one of 2k + 1 to those of k and k + 1; last halves k and k + 1
    rows = F.array(row(False, True, head(low)), row(False, False, head(F.when(odd == 1, low + 1).otherwise(low - 1))), row(True, True, tail(low + odd)), row(True, False, tail(F.when(odd == 1, low).otherwise(low + 1))))
    rows = words.select("word", "n", F.inline(rows))
    letters = words.agg(F.sum(F.length("word"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-4 * letters // TASK))
    full = written(rows.groupBy("half").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > block), "spelling-full")
    dealt = rows.withColumn("block", F.lit(0)).withColumn("answers", F.lit(True))
    if not full.isEmpty():
        dealt = split_join(rows, full.withColumn("blocks", F.ceil(F.col("rows") / block).cast("int")).drop("rows"), "half", "left")
        own = F.pmod(F.xxhash64("word"), F.coalesce("blocks", F.lit(1))).cast("int")
        # a word that asks does so in every block of its half; it answers in its own block
        every = F.when(F.col("asks"), F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)).otherwise(F.array(own))
        dealt = dealt.withColumn("own", own).withColumn("block", F.explode(every)).withColumn("answers", F.col("block") == F.col("own"))
    asked = dealt.repartition(parts, "half", "block").select("backward", "half", "asks", "answers", "word", "n")
    found = asked.mapInArrow(_searched, "word string, near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("least"), F.col("best").alias("best")))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.least")).alias("form_n"), F.col("b.best").alias("form"))


def followed(forms: DataFrame) -> DataFrame:
    """word and root of rows word, form: forms are followed to the last one. Each round doubles the way."""
    now = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = written(split_join(now, now.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left"), "spelling-roots")
        if further.where("next IS NOT NULL").isEmpty():
            return now
        now = further.select("word", F.coalesce("next", "root").alias("root"))


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """word, form, root, n, n_near, form_n - one row per word."""
    words = written(word_counts(docs, id_col, text_col), "spelling-words")
    near = near_digest(words, block)
    known = words.join(near, "word", "left")
    is_form = F.col("form_n") >= 2 * F.col("n")
    known = written(known.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("form_n")).alias("form_n"), F.when(is_form, F.col("form")).alias("form")), "spelling-forms")
    roots = followed(known.where("form IS NOT NULL"))
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


_CODES = "list_transform(string_split(doc_id::VARCHAR || ':' || w, ''), lambda x: ord(x)::BIGINT)"
_BYTES = f"flatten(list_transform({_CODES}, lambda x: CASE WHEN x < 128 THEN [x] ELSE [195, x - 64] END))"
ORACLE = f"""
WITH RECURSIVE {CRC_TABLE},
r AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
g AS (SELECT doc_id, w, count(*) AS c FROM r GROUP BY ALL),
h AS (SELECT w, c, {crc_sql(_BYTES)} AS h FROM g, crc),
x AS (SELECT CASE WHEN h % {MODULUS} = 0 THEN left(w, h % length(w)) || substring(w, h % length(w) + 2) ELSE w END AS word, sum(c)::BIGINT AS n FROM h GROUP BY 1 HAVING length(word) >= {LETTERS} AND sum(c) >= {LEAST}),
d AS (SELECT word, i, left(word, i) || substring(word, i + 2) AS less FROM x, unnest(range(length(word))) u(i)),
p AS (SELECT a.word, b.word AS other FROM d a JOIN d b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
UNION SELECT a.word, x.word FROM d a JOIN x ON x.word = a.less UNION SELECT x.word, a.word FROM d a JOIN x ON x.word = a.less),
b AS (SELECT p.word, count(*) AS n_near, first(x.n ORDER BY x.n DESC, x.word) AS best_n, first(x.word ORDER BY x.n DESC, x.word) AS best FROM p JOIN x ON x.word = p.other GROUP BY p.word),
f AS (SELECT x.word, x.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 2 * n THEN best_n END AS form_n, CASE WHEN best_n >= 2 * n THEN best END AS form FROM x LEFT JOIN b USING (word)),
c AS (SELECT word, word AS root, 0 AS far FROM f UNION ALL SELECT c.word, f.form, far + 1 FROM c JOIN f ON f.word = c.root WHERE f.form IS NOT NULL)
SELECT word, form, (SELECT arg_max(c.root, far) FROM c WHERE c.word = f.word) AS root, n, n_near, form_n FROM f
"""
