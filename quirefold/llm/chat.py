"""Operator 2: chat formatting by minimum-cost role repair.

A legal conversation may start with one system turn, then user and assistant alternate, the user first and the
assistant last. A dynamic program over that automaton decides for every turn whether it stays, takes another role, or
is merged with the turn before, and where empty turns are inserted, at the smallest total cost; then each turn is
rendered where it stands.

States are what has been written so far: nothing, system, user, assistant. A turn is a 4 x 4 matrix of costs between
states, and matrices multiply (minimum of sums) associatively. So a conversation of any length is cut into runs of
`RUN` turn numbers (by hash where a number has more turns than that): each run gives its matrix, a scan over a
conversation's runs gives each run the state that it is entered and left in, and the runs are solved apart from each
other. A conversation of more than `MOST` runs is scanned by a tree of products, `MOST` of its runs or nodes to a row. No
task holds a whole long conversation, and the result is a row a turn: the conversation's text is its segments in order.

Costs are whole numbers, ties fall to the first of stay, relabel, merge, insert, and to the lower state, at the ends of
runs first; so reruns agree, and costs are the same whatever the cuts. Defined cases: roles are read without case and outer blanks, and names in
`ALIASES` count as what they stand for; an unknown or null role may become any role at the same price; a null text is
empty; rows that repeat a turn number are ordered by a hash of role and text (those with more than `RUN` equal copies last); equal
rows are as many turns; a null conv_id
is a conversation of its own, turns without number come first; an empty table gives none.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import written
from quirefold.operators.sampling import numbered

RUN, MOST = 256, 1024
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = ("", "system", "user", "assistant")
ALIASES = {"human": "user", "prompter": "user", "bot": "assistant", "gpt": "assistant", "model": "assistant", "ai": "assistant", "developer": "system"}

# Prices.
STAY, RELABEL, MERGE, INSERT, SYSTEM_RELABEL = 0, 4, 1, 6, 5
NEVER = 1 << 60

#: Roles that may follow each state.
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
#: Empty turns that a conversation needs to end well.
CLOSE = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}


def _price(role: int, target: int) -> int:
    if role == target:
        return STAY
    return SYSTEM_RELABEL if SYSTEM in (role, target) and role else RELABEL


def _steps(role: int) -> dict[tuple[int, int], tuple[int, int, tuple[int, ...]]]:
    """(state before, state after) -> price, action and inserted turns of the cheapest way to write a turn of this role.

    Actions: 0 stay, 1 relabel, 2 merge, with or without insertions before.
    """
    best: dict[tuple[int, int], tuple[int, int, tuple[int, ...]]] = {}
    for state in range(4):
        ways = []
        for gap in ((), *((r,) for r in NEXT[state]), *((r, q) for r in NEXT[state] for q in NEXT[r])):
            last = gap[-1] if gap else state
            for target in NEXT[last]:
                price = INSERT * len(gap) + _price(role, target)
                ways.append((price, 0 if role == target else 1, gap, target))
        if state != START:
            ways.append((MERGE + _price(role, state), 2, (), state))
        for price, action, gap, target in ways:
            found = (price, action, gap)
            if (state, target) not in best or found < (best[state, target][0], best[state, target][1], best[state, target][2]):
                best[state, target] = found
    return best


STEPS = [_steps(role) for role in range(4)]
MATRICES = np.full((4, 4, 4), NEVER, np.int64)
for _role, _found in enumerate(STEPS):
    for (_a, _b), (_cost, _, _) in _found.items():
        MATRICES[_role, _a, _b] = _cost
FINISH = np.array([INSERT * len(CLOSE[s]) for s in range(4)], np.int64)


def role_number(role: str | None) -> int:
    name = (role or "").strip().lower()
    name = ALIASES.get(name, name)
    return ROLES.index(name) if name in ROLES else 0


def between(matrices: list[np.ndarray], enter: int, leave: int) -> list[tuple[int, int]]:
    """The states before and after each step of the cheapest way from one state to another; ties to the lower state."""
    costs = [np.where(np.arange(4) == enter, 0, NEVER)]
    for m in matrices:
        costs.append(np.minimum((costs[-1][:, None] + m).min(axis=0), NEVER))
    out, state = [], leave
    for m, before in zip(reversed(matrices), reversed(costs[:-1]), strict=True):
        prior = int((before + m[:, state]).argmin())
        out.append((prior, state))
        state = prior
    return out[::-1]


def combined(matrices: list[np.ndarray]) -> np.ndarray:
    """Costs between states over several runs."""
    total = np.where(np.eye(4, dtype=bool), 0, NEVER)
    for m in matrices:
        total = np.minimum((total[:, :, None] + m[None]).min(axis=1), NEVER)
    return total


def product(roles: list[int]) -> np.ndarray:
    """Costs between states over a run of turns."""
    return combined([MATRICES[role] for role in roles])


def path(roles: list[int], enter: int, leave: int) -> list[int]:
    """The states after each turn of the cheapest way from one state to another."""
    return [after for _, after in between([MATRICES[role] for role in roles], enter, leave)]


def ends(matrices: list[np.ndarray]) -> list[tuple[int, int]]:
    """The states in which each run of a conversation is entered and left; ties to the lower state."""
    return between(matrices, START, int((combined(matrices)[START] + FINISH).argmin()))


def escaped(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescaped(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def render(role: int, text: str, fresh: bool) -> str:
    """A turn's part of the rendered conversation: opened where it doesn't continue the turn before."""
    text = escaped(text)
    return f"<|im_end|>\n<|im_start|>{ROLES[role]}\n{text}" if fresh else f"\n{text}"


def _runs(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, run: int) -> DataFrame:
    """conv, run (five numbers that order a conversation's runs) and turns: about `run` rows each at most, equal ones once with
    their number of copies."""
    first = F.lit(-(2**63))
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.groupBy("conv", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
    rows = rows.withColumns({"h": F.xxhash64(F.col("role").isNull(), "role", "text"), "bucket": F.coalesce(F.floor(F.col("turn") / run).cast("long"), first)})
    full = rows.groupBy("conv", "bucket").agg(F.ceil(F.sum("copies") / run).alias("parts")).where("parts > 1")
    full = written(full.withColumnsRenamed({"conv": "c", "bucket": "b"}), "chat-full")
    rows = rows.join(full, F.col("conv").eqNullSafe(F.col("c")) & (F.col("bucket") == F.col("b")), "left")
    place = F.shiftrightunsigned(F.col("h").bitwiseXOR(first), 33)  # in the order of h, from 0 to 2^31
    part = F.when(F.col("parts").isNull(), 0).otherwise(F.shiftright(place * F.col("parts"), 31)).cast("long")
    own = F.when(F.col("parts").isNull(), first).otherwise(F.coalesce("turn", first))
    # copies that are more than a run have runs of their own
    many = F.col("copies") > run
    rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.when(many, F.floor((F.col("copies") - 1) / run)).otherwise(0))))
    rows = rows.withColumn("run", F.array("bucket", own, part, F.when(many, F.col("h")).otherwise(first), "block"))
    rows = rows.withColumn("copies", F.when(many, F.least(F.lit(run).cast("long"), F.col("copies") - F.col("block") * run)).otherwise(F.col("copies")).cast("int"))
    return rows.groupBy("conv", "run").agg(F.array_sort(F.collect_list(F.struct("turn", "h", "role", "text", "copies"))).alias("turns"))


def _each(turns: list[dict]) -> list[dict]:
    """A run's turns, each copy by itself."""
    return [t for t in turns for _ in range(t["copies"])]


def _matrices(items: list[dict]) -> list[np.ndarray]:
    return [np.array(i["costs"], np.int64).reshape(4, 4) for i in items]


def _scanned(listed: DataFrame, kind: str, key: str) -> DataFrame:
    """conv, at, enter, leave, last of rows conv, items (at and costs, in order) and, for items inside a conversation, the
    states `enter` and `leave` around them and whether they are its `last`. at has the type `key`."""
    whole = "enter" not in listed.columns

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            around = [(None, None, True)] * batch.num_rows if whole else list(zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True))
            for conv, items, (enter, leave, last) in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), around, strict=True):
                found = ends(_matrices(items)) if whole else between(_matrices(items), enter, leave)
                rows += [(conv, i["at"], a, b, last and k == len(items) - 1) for k, (i, (a, b)) in enumerate(zip(items, found, strict=True))]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [batch.schema.field(0).type, pa.list_(pa.int64()) if key == "array<long>" else pa.int64(), pa.int32(), pa.int32(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv", "at", "enter", "leave", "last"])

    return listed.mapInArrow(run, f"conv {kind}, at {key}, enter int, leave int, last boolean")


def _grouped(runs: DataFrame, *keys: Column | str) -> DataFrame:
    return runs.groupBy("conv", *keys).agg(F.array_sort(F.collect_list(F.struct("at", "costs"))).alias("items"))


def _same_conv(left: DataFrame, right: DataFrame, how: str, *also: Column) -> DataFrame:
    """Rows of left joined with right's on the conversation, nulls being one, and on what else is asked."""
    right = right.withColumnRenamed("conv", "__c")
    match = F.col("conv").eqNullSafe(F.col("__c"))
    for one in also:
        match &= one
    return left.join(right, match, how).drop("__c")


def _states_of_long(weighed: DataFrame, kind: str, most: int) -> DataFrame:
    """`_states` of conversations with more than `most` runs: a tree over the runs, `most` of a conversation to a node.

    Matrices multiply upwards until no conversation has more than `most` nodes; these are scanned, and the states go down
    again, a level at a time.
    """
    placed = written(numbered(weighed.withColumn("key", F.struct("conv", "run")), "key", name="place").drop("key"), "chat-placed")
    first = placed.groupBy("conv").agg(F.min("place").alias("first"))
    levels = [written(_same_conv(placed, first, "inner").select("conv", (F.col("place") - F.col("first")).alias("at"), "run", "costs"), "chat-tree")]

    def multiply(batches):
        for batch in batches:
            costs = [combined(_matrices(items)).ravel().tolist() for items in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(costs, pa.list_(pa.int64()))], ["conv", "at", "costs"])

    up = F.floor(F.col("at") / most).cast("long").alias("up")
    while (levels[-1].agg(F.max("at")).first()[0] or 0) >= most:
        levels.append(written(_grouped(levels[-1], up).select("conv", "up", "items").mapInArrow(multiply, f"conv {kind}, at long, costs array<long>"), "chat-tree"))
    states = _scanned(_grouped(levels[-1]), kind, "long")
    for level in reversed(levels[:-1]):
        above = states.withColumnRenamed("at", "above")
        states = _scanned(_same_conv(_grouped(level, up), above, "inner", F.col("up") == F.col("above")).select("conv", "items", "enter", "leave", "last"), kind, "long")
    states = states.withColumnRenamed("at", "place")
    return _same_conv(levels[0].select("conv", "at", "run"), states, "inner", F.col("at") == F.col("place")).select("conv", F.col("run").alias("at"), "enter", "leave", "last")


def _states(runs: DataFrame, weighed: DataFrame, kind: str, most: int) -> DataFrame:
    """conv, at (the run), and the states in which each run is entered and left, and whether it is its conversation's last."""
    weighed = weighed.withColumn("at", F.col("run"))
    long = written(runs.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("conv"), "chat-long")
    if long.isEmpty():
        return _scanned(_grouped(weighed), kind, "array<long>")
    short = _scanned(_grouped(_same_conv(weighed, long, "left_anti")), kind, "array<long>")
    return short.unionByName(_states_of_long(_same_conv(weighed, long, "left_semi").select("conv", "run", "costs"), kind, most))


def repaired(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", run: int = RUN, most: int = MOST) -> DataFrame:
    """conv_id, turn, role (as read), new_role, action (stay, relabel, merge), inserted (empty turns before), cost, closing
    (empty turns after a conversation's last row), segment (its part of the rendered text) and place (six numbers that
    order a conversation's rows), a row a turn."""
    runs = written(_runs(turns, conv_col, turn_col, role_col, text_col, run), "chat-runs")
    kind = turns.schema[conv_col].dataType.simpleString()

    def weigh(batches):
        for batch in batches:
            roles = [[role_number(t["role"]) for t in _each(row)] for row in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([product(r).ravel().tolist() for r in roles], pa.list_(pa.int64()))], ["conv", "run", "costs"])

    def solve(batches):
        for batch in batches:
            rows: list[tuple] = []
            for conv, run, items, enter, leave, last in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                items = _each(items)
                roles = [role_number(t["role"]) for t in items]
                state = enter
                for k, (turn, role, after) in enumerate(zip(items, roles, path(roles, enter, leave), strict=True)):
                    cost, action, gap = STEPS[role][state, after]
                    close = CLOSE[after] if last and k == len(items) - 1 else ()
                    text = "".join(render(r, "", True) for r in gap) + render(after, turn["text"], action != 2) + "".join(render(r, "", True) for r in close) + ("<|im_end|>\n" if last and k == len(items) - 1 else "")
                    text = text.removeprefix("<|im_end|>\n") if state == START else text
                    rows.append((conv, turn["turn"], turn["role"], ROLES[after], ("stay", "relabel", "merge")[action], [ROLES[r] for r in gap], cost, [ROLES[r] for r in close], text, [*run, k]))
                    state = after
            columns = list(zip(*rows, strict=True)) or [()] * 10
            names_ = pa.list_(pa.string())
            kinds = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.string(), pa.string(), names_, pa.int32(), names_, pa.string(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", "turn", "role", "new_role", "action", "inserted", "cost", "closing", "segment", "place"])

    weighed = runs.select("conv", "run", "turns").mapInArrow(weigh, f"conv {kind}, run array<long>, costs array<long>")
    states = _states(runs, weighed, kind, most).withColumnsRenamed({"conv": "__conv", "at": "__run"})
    joined = runs.join(states, F.col("conv").eqNullSafe(F.col("__conv")) & (F.col("run") == F.col("__run")))
    return joined.select("conv", "run", "turns", "enter", "leave", "last").mapInArrow(
        solve, f"conv_id {kind}, turn long, role string, new_role string, action string, inserted array<string>, cost int, closing array<string>, segment string, place array<long>"
    )


def rendered(turns: DataFrame, **names) -> DataFrame:
    """conv_id, cost and the whole rendered text of each conversation (for conversations that fit in a row)."""
    rows = repaired(turns, **names).withColumn("cost", F.col("cost") + INSERT * F.size("closing"))
    parts = F.array_sort(F.collect_list(F.struct("place", "segment")))
    return rows.groupBy("conv_id").agg(F.sum("cost").alias("cost"), F.array_join(F.transform(parts, lambda p: p["segment"]), "").alias("text"))
