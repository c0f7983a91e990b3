"""Conversation structure repair: the cheapest edits that make a conversation ``(s?(ua)+)?`` in role initials, by Hirschberg's divide and
conquer over four states.

The states are what the repaired conversation holds so far: nothing, a system turn, a user turn to be answered, an answer. A row is an
element with a 4 x 4 table: the least (cost, edits) from any state before it to any state after it. A forward vector holds, for each state, the
cheapest way from the start and the rank of its edits among the four; a backward vector the cost to the end. They meet in the middle: of
the states with the least sum, the one whose edits so far are least is the crossing, and both halves are solved alike, so no table of
back pointers and no string is kept. Edits up to a row end in the row's own edit and hold one of them per row, so none begins another, and ranks
order whole strings.

Blocks of ``BLOCK`` rows are elements too: each is first reduced to its own 4 x 4 table of costs and ranks, a conversation's tables are
solved first, then every block between its two known states. A conversation of any length spreads over tasks."""
from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain as chain_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barflow.llm.common import SPACES, query, read, stored
from barflow.llm.transcripts import packed, runs

BLOCK = 4096        # rows; a power of two
NOTHING, SYSTEM, USER, ANSWER = range(4)
FAR = 1 << 40
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: After which state an inserted or re-roled turn leads where: a user turn is due everywhere but after a user turn.
DUE = {NOTHING: USER, SYSTEM: USER, USER: ANSWER, ANSWER: USER}
KINDS, FAULTS = "sua", [None, "blank", "duplicate", "truncated"]


def turned(state: int, kind: int) -> int | None:
    """The state after keeping a row of that kind (place in ``KINDS``)."""
    if kind == 0:
        return SYSTEM if state == NOTHING else None
    return {1: USER, 2: ANSWER}.get(kind) if DUE[state] == {1: USER, 2: ANSWER}.get(kind) else None


def row_table(kind: int, must_go: bool, cut: bool) -> list[list[tuple[int, str]]]:
    """Least (cost, edits) from state to state over one row, inserts before it included."""
    best = [[(FAR, "")] * 4 for _ in range(4)]
    for p in range(4):
        at = p
        for n in range(3):          # more inserts than two come back to where they were
            ways = [(at, DELETE, "D")]
            if not must_go:
                ways.append((DUE[at], REROLE + TRUNCATED * cut, "R"))
                if turned(at, kind) is not None:
                    ways.append((turned(at, kind), TRUNCATED * cut, "K"))
            for q, cost, edit in ways:
                best[p][q] = min(best[p][q], (cost + INSERT * n, "I" * n + edit))
            at = DUE[at]
    return best


#: By class, 4 * kind + fault: kinds s, u, a, other; faults as in ``FAULTS``.
ROWS = [row_table(k, f in (1, 2), f == 3) for k in range(4) for f in range(4)]
#: What ends a conversation in each state, as inserts.
END = [0, 2, 1, 0]
_ORDER = sorted({e for t in ROWS for line in t for _, e in line})


def element(table: list[list[tuple[int, str]]]) -> tuple:
    """(cost, rank of the edits) for each pair of states, flat."""
    return tuple((c, _ORDER.index(e)) for line in table for c, e in line)


ELEMENTS = [element(t) for t in ROWS]
CLOSE = tuple((INSERT * END[p] if q == NOTHING else FAR, END[p]) for p in range(4) for q in range(4))


@lru_cache(1 << 14)
def ahead(vector: tuple, e: tuple) -> tuple[int, tuple]:
    """(what was taken off all costs, the forward vector after ``e``): the costs' least is 0, so few vectors recur and are remembered."""
    new = [min((vector[p][0] + e[4 * p + q][0], vector[p][1], e[4 * p + q][1]) for p in range(4)) for q in range(4)]
    ranks = sorted({n[1:] for n in new if n[0] < FAR})
    low = min(n[0] for n in new)
    return low, tuple((n[0] - low, ranks.index(n[1:])) if n[0] < FAR else (FAR, 0) for n in new)


@lru_cache(1 << 14)
def behind(vector: tuple, e: tuple) -> tuple:
    """The backward vector before ``e``."""
    new = [min(e[4 * p + q][0] + vector[q] for q in range(4)) for p in range(4)]
    low = min(new)
    return tuple(n - low if n < FAR else FAR for n in new)


def entering(state: int) -> tuple:
    return tuple((0 if s == state else FAR, 0) for s in range(4))


def crossings(elements: list[tuple], enter: int, leave: int) -> list[int]:
    """The state after each element on the cheapest way from ``enter`` to ``leave``, of equals the one with the least edits."""
    states = [leave] * len(elements)
    todo = [(0, len(elements), enter, leave)]
    while todo:
        a, b, p, q = todo.pop()
        if b - a < 2:
            continue
        mid, fore, back = (a + b) // 2, entering(p), tuple(0 if s == q else FAR for s in range(4))
        for e in elements[a:mid]:
            fore = ahead(fore, e)[1]
        for e in reversed(elements[mid:b]):
            back = behind(back, e)
        states[mid - 1] = s = min(range(4), key=lambda s: (fore[s][0] + back[s], fore[s][1]))
        todo += [(a, mid, p, s), (mid, b, s, q)]
    return states


def block_table(elements: list[tuple]) -> tuple:
    """A block as one element."""
    out = []
    for p in range(4):
        cost, v = 0, entering(p)
        for e in elements:
            less, v = ahead(v, e)
            cost += less
        out += [(c + cost if c < FAR else FAR, r) for c, r in v]
    return tuple(out)


def judged(turns: DataFrame) -> DataFrame:
    """Small rows of ``turns``: conv_id, turn, role, sha (of the text), pos (place in the order of all rows), class. Rows follow by turn, NULLs first,
    then role, then sha."""
    text = F.coalesce("text", F.lit(" "))
    body = F.btrim(text, F.lit(SPACES))
    small = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.sha2(text.cast("binary"), 256).alias("sha"),
                         (F.length(body) == 0).alias("blank"), (~F.substring(body, -1, 1).isin(*".!?")).alias("cut"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("sha")]
    spread = [*order, F.monotonically_increasing_id()]       # so that repeated rows spread as well
    rows = stored(small.repartitionByRange(*spread).sortWithinPartitions(*order).withColumn("pos", F.monotonically_increasing_id()), "repair-rows")
    # of rows that say the same, all but the first are duplicates; places are unique, so the join is even
    first = rows.where("NOT blank").groupBy("conv_id", "role", "sha").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    fault = F.when(F.col("blank"), 1).when(F.col("first").isNull(), 2).when(F.col("cut"), 3).otherwise(0)
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return rows.join(first, "pos", "left").select("conv_id", "turn", "role", "sha", "pos", (4 * kind + fault).alias("class"))


def edits(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """``judged`` rows of ``turns`` with ``before`` (state before the row), ``edits`` (initials: inserts before the row and its own edit; after the last row of a
    conversation also the inserts that end it) and ``cost``."""
    conv = turns.schema["conv_id"].dataType.simpleString()
    rows = stored(judged(turns), "repair-classes").withColumn("block", F.floor(F.col("pos") / block).cast("long"))
    keys = ["conv_id", "block"]
    sorted_ = rows.repartition("block").sortWithinPartitions(*keys, "pos")

    def table(g: list[tuple]) -> Iterator[tuple]:
        t = block_table([ELEMENTS[r[2]] for r in g])
        yield g[0][0], g[0][1], [c for c, _ in t], [r for _, r in t]

    numbers = pa.list_(pa.int64())
    tables = over_runs(2, [("conv_id", 0), ("block", 1), ("costs", numbers), ("ranks", numbers)], table)
    reduced = sorted_.select(*keys, "class").mapInArrow(tables, f"conv_id {conv}, block bigint, costs array<bigint>, ranks array<bigint>")

    def chain(g: list[tuple]) -> Iterator[tuple]:
        states = crossings([*(tuple(zip(r[2], r[3])) for r in g), CLOSE], NOTHING, NOTHING)
        for i, (r, p, q) in enumerate(zip(g, [NOTHING, *states], states)):
            yield r[0], r[1], p, q, i == len(g) - 1

    chains = over_runs(1, [("conv_id", 0), ("block", 1), ("enter", pa.int32()), ("leave", pa.int32()), ("final", pa.bool_())], chain)
    # one row per BLOCK rows of a conversation
    chained = (reduced.repartition("conv_id").sortWithinPartitions(*keys)
               .mapInArrow(chains, f"conv_id {conv}, block bigint, enter int, leave int, final boolean"))
    c = chained.select(F.col("conv_id").alias("_c"), F.col("block").alias("_b"), "enter", "leave", "final")
    known = rows.join(c, rows["conv_id"].eqNullSafe(c["_c"]) & (rows["block"] == c["_b"]))
    turn = turns.schema["turn"].dataType.simpleString()

    def solve(g: list[tuple]) -> Iterator[tuple]:
        enter, leave, final = g[0][3:6]
        states = crossings([ELEMENTS[r[2]] for r in g], enter, leave)
        for i, (r, p, q) in enumerate(zip(g, [enter, *states], states)):
            cost, edit = ROWS[r[2]][p][q]
            tail = END[q] if final and i == len(g) - 1 else 0
            yield *r[:3], *r[6:], p, edit + "I" * tail, cost + INSERT * tail

    solved = over_runs(2, [("conv_id", 0), ("block", 1), ("class", 2), ("turn", 6), ("role", 7), ("sha", 8), ("pos", 9),
                           ("before", pa.int32()), ("edits", pa.string()), ("cost", pa.int64())], solve)
    return (known.repartition("block").sortWithinPartitions(*keys, "pos")
            .select(*keys, "class", "enter", "leave", "final", "turn", "role", "sha", "pos")
            .mapInArrow(solved, f"conv_id {conv}, block bigint, class int, turn {turn}, role string, sha string, pos bigint, before int, edits string, cost bigint"))


def over_runs(n_keys: int, columns: list[tuple], each: Callable[[list[tuple]], Iterator[tuple]]) -> Callable:
    """A function over Arrow batches that gives the rows of ``each`` run of rows with equal first ``n_keys`` columns. ``columns``: (name, type),
    where a number stands for the type of that column of the input."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = iter(batches)
        head = next(batches, None)
        if head is not None:
            schema = pa.schema([(n, head.schema.types[t] if isinstance(t, int) else t) for n, t in columns])
            yield from packed((r for g in runs(chain_((head,), batches), n_keys) for r in each(g)), schema)
    return run


def repair(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """``turns`` (conv_id, turn, role, text, ...) -> one row per turn in the order of ``pos``: conv_id, pos, turn, role, fault (blank, duplicate, truncated or
    NULL), edits (initials of Keep, Rerole, Delete, Insert), cost, lines (array of role, text: what stands in the repaired conversation for this row).

    Rows of a conversation follow by turn, NULLs first; ties by role, then the text's SHA-256. A NULL role or text counts as one space (so the text is
    blank and goes); rows with a NULL conv_id are one conversation; roles other than s..., u..., a... can only be re-roled or deleted. Repeated rows are
    duplicates of the first. Texts of any length move once; a conversation of any length is solved in blocks; empty tables give no rows; other columns
    are not read."""
    e = edits(turns, block)
    t = (turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
         .withColumn("sha", F.sha2(F.col("text").cast("binary"), 256)).dropDuplicates(["conv_id", "turn", "role", "sha"])
         .select(F.col("conv_id").alias("_c"), F.col("turn").alias("_t"), F.col("role").alias("_role"), F.col("sha").alias("_sha"), "text"))
    met = e.join(t, e["conv_id"].eqNullSafe(t["_c"]) & e["turn"].eqNullSafe(t["_t"]) & (e["role"] == t["_role"]) & (e["sha"] == t["_sha"]))
    line = "struct<role: string, text: string>"

    def new(k: Column) -> Column:
        """An inserted turn, where k turns were made since a state that asks for a user turn."""
        return F.struct(F.when(k % 2 == 0, "user").otherwise("assistant").alias("role"), F.lit("").alias("text"))

    lead, own = F.length(F.regexp_extract("edits", "^I*", 0)), F.regexp_extract("edits", "[KRD]", 0)
    tail = F.length(F.regexp_extract("edits", "I*$", 0))
    off = (F.col("before") == USER).cast("int")
    none = F.array().cast(f"array<{line}>")

    def inserts(n: Column, start: Column) -> Column:
        return F.when(n == 0, none).when(n == 1, F.array(new(start))).otherwise(F.array(new(start), new(start + 1)))

    kept = F.struct(F.when(own == "R", F.when((off + lead) % 2 == 0, "user").otherwise("assistant")).otherwise(F.col("role")).alias("role"), "text")
    #: where the inserts that end the conversation begin: an answer after a user turn, a user turn after a system turn
    last = F.when(tail == 1, 1).otherwise(0)
    lines = F.concat(inserts(lead, off), F.when(own == "D", none).otherwise(F.array(kept)), inserts(tail, last))
    fault = F.element_at(F.array(*[F.lit(x) for x in FAULTS]), F.col("class") % 4 + 1)
    return met.select("conv_id", "pos", "turn", "role", fault.alias("fault"), "edits", "cost", lines.alias("lines"))


class Tally:
    """What is known of a conversation after some of its rows."""

    def __init__(self, key):
        self.key, self.first, self.last, self.turns, self.illegal, self.cost = key, None, None, 0, 0, 0
        self.faults, self.audit, self.sha, self.initial, self.some = Counter(), [], hashlib.sha256(), None, False

    def add(self, turn, fault, initial: str, edit: str, cost: int, lines: list[str]) -> None:
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last, self.turns = turn, self.turns + 1
        if fault:
            self.faults[fault] += 1
        self.illegal += self.initial is not None and self.initial + initial not in ("su", "ua", "au")
        self.initial = initial
        self.cost += cost
        self.audit.append(edit)
        for line in lines:
            self.sha.update((("\n" if self.some else "") + line).encode())
            self.some = True


def summary(rows: DataFrame) -> DataFrame:
    """``repair``'s rows, conversation by conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit (all edits), repaired_sha256 (over the lines as
    ``role:text``, newlines between them). SHA-256 has to see a conversation's bytes one after another, so these stream in order through one task,
    which holds one batch of them and the audit."""
    conv = rows.schema["conv_id"].dataType.simpleString()
    slim = rows.select("conv_id", "turn", "fault", F.substring("role", 1, 1).alias("initial"), "edits", "cost",
                       F.transform("lines", lambda x: F.concat(x.role, F.lit(":"), x.text)).alias("lines"), "pos")

    def result(t: Tally) -> tuple:
        gaps = t.last - t.first + 1 - t.turns if t.turns else 0
        return t.key, gaps, *(t.faults[f] for f in FAULTS[1:]), t.illegal, t.cost, "".join(t.audit), t.sha.hexdigest()

    def tallied(rows: Iterator[tuple]) -> Iterator[tuple]:
        now = None
        for conv_id, *row in rows:
            if now is None or conv_id != now.key:
                if now is not None:
                    yield result(now)
                now = Tally(conv_id)
            now.add(*row)
        if now is not None:
            yield result(now)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = iter(batches)
        head = next(batches, None)
        if head is not None:
            schema = pa.schema([("conv_id", head.schema.types[0]), *[(n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                                ("audit", pa.string()), ("repaired_sha256", pa.string())])
            rows = (r for b in chain_((head,), batches) for s in range(0, b.num_rows, 256) for r in zip(*(c.to_pylist() for c in b.slice(s, 256).columns)))
            yield from packed(tallied(rows), schema, 1024)

    out = f"conv_id {conv}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
    return slim.repartition("conv_id").sortWithinPartitions("conv_id", "pos").drop("pos").mapInArrow(digest, out)


def damaged(turns: DataFrame) -> DataFrame:
    """Rows of ``turns`` with planted faults, by crc32 of ``conv_id:turn`` modulo 20: 0 is lost, 1 has no text, 2 no sentence ends, 3 comes twice, 4 is a user's.
    NULLs count as one space."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))     # noqa: E731
    kind = F.pmod(F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")), F.lit(20))
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(part("text"), "[.!?]", "")).otherwise(part("text"))
    return (turns.where(kind != 0)
            .select("conv_id", "turn", F.when(kind == 4, "user").otherwise(part("role")).alias("role"), text.alias("text"),
                    F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("_copy")).drop("_copy"))


def all_conversations(found: DataFrame, turns: DataFrame) -> DataFrame:
    """``summary`` rows, and zeros for the conversations of ``turns`` that have none."""
    every = turns.select(F.col("conv_id").alias("_c")).distinct()
    zero = {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    return (every.join(found, every["_c"].eqNullSafe(found["conv_id"]), "left")
            .select(F.col("_c").alias("conv_id"), *[F.coalesce(c, F.lit(zero.get(c, 0))).alias(c) for c in found.columns[1:]]))


@query("op12_conversation_repair")
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations")
    return all_conversations(summary(repair(damaged(turns))), turns)
