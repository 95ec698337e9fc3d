"""Repair of conversations as a shortest path, found by the auction algorithm.

A conversation's rows, in order, are the layers of a lattice whose states are the role given out last (none, system,
user, assistant).  An edit is an arc with an integer cost: Keep, Rerole to user or assistant, Delete, Insert an
empty-text row.  A path of the auction holds a price for every node it meets; the last node of the path is either
extended along its cheapest arc or, if that arc is dearer than the node's price, gets that price and leaves the path.
Once the path reaches the end, the prices are dual optimal: every cheapest path consists of tight arcs (price of the
tail = cost + price of the head), so the least audit string is read off them letter by letter.

Scale: a row is one letter of a code (``_row_arcs``), so a lattice is a string.  Rows are sorted over ranges of
(conversation, turn), which splits long conversations, and cut into segments of at most ``SEGMENT`` rows.  The segments
of a longer conversation are solved for all pairs of states at their ends; these 4 x 4 tables are the layers of a
smaller lattice, whose prices then end the segments.  Rows that agree in everything are counted, not kept apart.  What
one task must hold of a conversation is a table per segment and its audit, which is one cell of the result.  The digest
of the repaired text is a SHA-256, a chain by definition: it streams through one task per conversation.

Rows: null conversation ids are one conversation of their own; a null turn comes first; null roles and texts are one
space (so blank, and a role that nothing keeps); rows of one turn go by role, then text; repeated rows are duplicates; a
conversation without rows (left) has zeros, an empty audit and the digest of the empty string; an empty table gives no
rows; columns beside the four named ones are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from petrilens.llm.common import bounded_batches, fresh_path, handing_back

#: Rows of a segment, and segments of a step above it.
SEGMENT = 128
#: Costs of the edits; an undeleted truncated row adds 1.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
_INF = 1 << 40
#: State -> state after a user or assistant row has been given out next; states: none, system, user, assistant.
_NEXT = (2, 2, 3, 2)
_KEEP = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
_ENDS = (0, _INF, _INF, 0)
_ROLES = (None, "system", "user", "assistant")

Arcs = tuple[tuple[tuple[str, int, int], ...], ...]


@lru_cache(maxsize=None)
def _row_arcs(code: str) -> Arcs:
    """Per state the arcs (edit, cost, next state) over a row: s, u, a or x by its role's initial, upper case if it is
    truncated, d if it must be deleted."""
    late = TRUNCATED if code.isupper() else 0
    out = []
    for x in range(4):
        arcs = [("D", DELETE, x)]
        if code != "d":
            if (y := _KEEP.get(code.lower(), {}).get(x)) is not None:
                arcs.append(("K", late, y))
            arcs.append(("R", REROLE + late, _NEXT[x]))
        out.append(tuple(arcs))
    return tuple(out)


def _table_arcs(table: Iterable[int]) -> Arcs:
    t = list(table)
    return tuple(tuple(("", t[4 * x + y], y) for y in range(4) if t[4 * x + y] < _INF) for x in range(4))


def auction(steps: list[Arcs], ends: tuple[int, ...], origins: Iterable[int]) -> list[int]:
    """Prices of the nodes (4 a layer) for which every arc costs at least the fall in price, exact (the least cost to
    the end) on all cheapest paths from the origins, states of the first layer.  Nodes without a way to the end have
    the price ``_INF``; the others start at the sum of the least costs of the layers ahead, which no path beats."""
    n, ahead = len(steps), min(ends)
    p = [_INF] * (4 * n + 4)
    for i in range(n, -1, -1):
        at = 4 * i
        if i < n:
            ahead += min(c for arcs in steps[i] for _, c, _ in arcs)
        for x in range(4):
            if ends[x] < _INF if i == n else any(p[at + 4 + y] < _INF for _, _, y in steps[i][x]):
                p[at + x] = ahead
        for x in (2, 3, 2, 0, 1):
            if p[at + _NEXT[x]] < _INF:
                p[at + x] = ahead
    for origin in origins:
        path = [origin]
        while p[origin] < _INF:
            node = path[-1]
            i, x = node >> 2, node & 3
            to = 4 * i + _NEXT[x]
            best = INSERT + p[to]
            if i < n:
                for _, cost, y in steps[i][x]:
                    if cost + p[4 * i + 4 + y] < best:
                        to = 4 * i + 4 + y
                        best = cost + p[to]
            elif ends[x] <= best:
                best, to = ends[x], -1
            if best > p[node]:
                p[node] = best
                if len(path) > 1:
                    path.pop()
            elif to < 0:
                break
            else:
                path.append(to)
    return p


def _leading(steps: list[Arcs], ends: tuple[int, ...], p: list[int]) -> list[bool]:
    """Nodes from which tight arcs lead to the end."""
    n = len(steps)
    good = [False] * len(p)
    for i in range(n, -1, -1):
        at = 4 * i
        for x in range(4):
            price = p[at + x]
            if price < _INF:
                good[at + x] = ends[x] == price if i == n else any(good[at + 4 + y] and cost + p[at + 4 + y] == price for _, cost, y in steps[i][x])
        for x in (2, 3, 2, 0, 1):
            to = at + _NEXT[x]
            good[at + x] = good[at + x] or (good[to] and p[at + x] == INSERT + p[to])
    return good


def _trace(steps: list[Arcs], ends: tuple[int, ...], p: list[int], good: list[bool], x: int) -> str:
    """The least string of edits along tight arcs from state ``x`` of the first layer."""
    i, out = 0, []
    while i < len(steps) or ends[x] != p[4 * i + x]:
        price, to = p[4 * i + x], 4 * i + _NEXT[x]
        best = ("I", i, _NEXT[x]) if good[to] and price == INSERT + p[to] else ("Z", i, x)
        if i < len(steps):
            best = min([best, *((edit, i + 1, y) for edit, cost, y in steps[i][x] if good[4 * i + 4 + y] and price == cost + p[4 * i + 4 + y])])
        edit, i, x = best
        out.append(edit)
    return "".join(out)


def _steps(codes: str) -> list[Arcs]:
    return [_row_arcs(c) for c in codes]


@lru_cache(maxsize=50_000)
def edits(codes: str, ends: tuple[int, ...] = _ENDS, origins: tuple[int, ...] = (0,)) -> list[str | None]:
    """Per state at the start the least of the cheapest strings of edits of the rows."""
    steps = _steps(codes)
    p = auction(steps, ends, origins)
    good = _leading(steps, ends, p)
    return [_trace(steps, ends, p, good, x) if x in origins and good[x] else None for x in range(4)]


def _distances(steps: list[Arcs]) -> list[int]:
    """Least costs from each state before the steps to each state behind them."""
    to = [auction(steps, tuple(0 if x == y else _INF for x in range(4)), range(4)) for y in range(4)]
    return [to[y][x] for x in range(4) for y in range(4)]


def segment_ends(tables: list[list[int]], ends: tuple[int, ...] = _ENDS, origins: tuple[int, ...] = (0,)) -> list[tuple[int, ...]]:
    """For each segment, given by its table of distances, the costs still to come behind it per state (``_INF`` off
    the cheapest paths).  Over ``SEGMENT`` tables are first joined to fewer, so that no auction is longer."""
    if len(tables) > SEGMENT:
        parts = [tables[k : k + SEGMENT] for k in range(0, len(tables), SEGMENT)]
        above = segment_ends([_distances([_table_arcs(t) for t in part]) for part in parts], ends, origins)
        return [e for part, end in zip(parts, above, strict=True) for e in segment_ends(part, end, (0, 1, 2, 3))]
    steps = [_table_arcs(t) for t in tables]
    p = auction(steps, ends, origins)
    good = _leading(steps, ends, p)
    between = [tuple(p[k] if good[k] else _INF for k in range(4 * i, 4 * i + 4)) for i in range(1, len(steps))]
    return [*between, ends]  # what is inserted at a boundary is inserted by the segment behind it, or by the last one


def damage(rows: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """conv_id, turn, role, text, n (copies) of the rows after damage by crc32 of ``conv_id:turn`` modulo 20: 0 drops a
    row, 1 empties its text, 2 removes its ``.!?``, 3 repeats it, 4 makes it the user's."""
    whole = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(whole(id_col), F.lit(":"), whole("turn"))) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.translate(whole("text"), ".!?", "")).otherwise(whole("text"))
    role = F.when(fault == 4, "user").otherwise(whole("role"))
    return rows.select(F.col(id_col).alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.when(fault == 3, 2).otherwise(1).alias("n"), fault.alias("_fault")).where("_fault > 0").drop("_fault")


def _ordered(rows: DataFrame) -> DataFrame:
    """Distinct rows of (conv_id, turn, role, text, n), written in order as a table: pos numbers them, fault is b
    (blank), d (seen in an earlier turn), t (truncated) or empty, code is the row's letter (see ``_row_arcs``)."""
    spark = rows.sparkSession
    lines = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n")).withColumn("h", F.sha2("text", 256))
    met = lines.groupBy(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("h").alias("_h"))
    met = met.agg(F.count(F.lit(1)).alias("_k"), F.count("turn").alias("_turns"), F.min("turn").alias("_least")).where("_k > 1")
    met = met.select("_c", "_r", "_h", F.when(F.col("_turns") == F.col("_k"), F.col("_least")).alias("_first"))
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("h") == F.col("_h"))
    lines = lines.join(met, same, "left")
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    fault = F.when(last == "", "b").when(F.col("_r").isNotNull() & ~F.col("turn").eqNullSafe(F.col("_first")), "d").when(~last.isin(".", "!", "?"), "t").otherwise("")
    initial = F.substring("role", 1, 1)
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    lines = lines.select("conv_id", "turn", "role", "text", "n", fault.alias("fault"), initial.alias("initial"), letter.alias("letter"))
    lines = lines.withColumn("code", F.when(F.col("fault").isin("b", "d"), "d").when(F.col("fault") == "t", F.upper("letter")).otherwise(F.col("letter"))).drop("letter")
    path, n = fresh_path(spark, "conversations"), max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    lines = lines.repartitionByRange(n, "conv_id", "turn", "role", F.substring("text", 1, 32)).sortWithinPartitions("conv_id", "turn", "role", "text")
    lines = lines.withColumn("pos", F.monotonically_increasing_id())
    lines.write.parquet(path)
    return spark.read.schema(lines.schema).parquet(path)


def _segments(rows: DataFrame) -> DataFrame:
    """conv_id, pos (of the first row) and audits (per state before the segment) of every segment."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    block = F.struct(F.shiftright("pos", 33).alias("part"), F.floor(F.col("pos").bitwiseAND(F.lit((1 << 33) - 1)) / SEGMENT).alias("block"))
    codes = F.concat("code", F.expr("repeat('d', cast(n - 1 as int))"))
    parts = rows.groupBy("conv_id", block.alias("at")).agg(F.sort_array(F.collect_list(F.struct("pos", codes.alias("c")))).alias("all"))
    parts = parts.select("conv_id", F.col("all")[0]["pos"].alias("pos"), F.array_join(F.col("all")["c"], "").alias("codes"))
    parts = parts.withColumn("many", F.count(F.lit(1)).over(Window.partitionBy("conv_id")) > 1)

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.array([_distances(_steps(c)) for c in b.column(2).to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), found], ["conv_id", "pos", "costs"])

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for conv, parts in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                found = segment_ends([x["costs"] for x in parts])
                yield pa.RecordBatch.from_arrays([pa.array([conv.as_py()] * len(parts), b.schema.field(0).type), pa.array([x["pos"] for x in parts], pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["_c", "_p", "ends"])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [edits(c) if e is None else edits(c, tuple(e), (0, 1, 2, 3)) for c, e in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.list_(pa.string()))], ["conv_id", "pos", "audits"])

    long = parts.where("many").mapInArrow(tables, f"conv_id {kind}, pos long, costs array<long>")
    long = long.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", "costs"))).alias("all"))
    long = long.mapInArrow(ends, f"_c {kind}, _p long, ends array<long>")
    parts = parts.join(long, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("pos") == F.col("_p")), "left")
    return parts.select("conv_id", "pos", "codes", "ends").mapInArrow(solve, f"conv_id {kind}, pos long, audits array<string>")


class _Repair:
    """One conversation while its rows stream past."""

    def __init__(self, conv) -> None:
        self.conv, self.state, self.audit, self.cost, self.digest, self.any = conv, 0, [], 0, hashlib.sha256(), False
        self.edits: Iterator[str] = iter(())
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.least = self.turn = self.role = None

    def start(self, audits: list[str | None]) -> None:
        """The next segment; what the segment before inserted behind its last row comes first."""
        self._inserts()
        self.audit.append(audits[self.state])
        self.edits = iter(audits[self.state])

    def _line(self, role: str, text: str, state: int) -> None:
        self.digest.update(f"{chr(10) * self.any}{role}:{text}".encode())
        self.any, self.state = True, state

    def _inserts(self) -> str:
        """Carries out insertions up to the next other edit, which is returned."""
        for edit in self.edits:
            if edit != "I":
                return edit
            self.cost += INSERT
            self._line(_ROLES[_NEXT[self.state]], "", _NEXT[self.state])
        return ""

    def row(self, turn: int | None, role: str, text: str, n: int, fault: str, initial: str) -> None:
        if turn is not None:
            self.least = turn if self.turns == 0 else self.least
            self.turns += turn != self.turn
            self.turn = turn
        self.illegal += n - 1 + (self.role is not None and self.role + initial not in ("su", "ua", "au"))
        self.role = initial
        self.blank += n * (fault == "b")
        self.duplicate += n * (fault == "d") + (n - 1) * (fault not in ("b", "d"))
        self.truncated += fault == "t"
        for _ in range(n):
            edit = self._inserts()
            self.cost += DELETE if edit == "D" else REROLE * (edit == "R") + TRUNCATED * (fault == "t")
            if edit == "K":
                self._line(role, text, "?sua".index(initial))
            elif edit == "R":
                self._line(_ROLES[_NEXT[self.state]], text, _NEXT[self.state])

    def done(self) -> tuple:
        self._inserts()
        gaps = 0 if self.least is None else self.turn - self.least + 1 - self.turns
        return (self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest())


def repair(rows: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Cheapest repair of every conversation of ``rows`` (conv_id, turn, role, text, n copies), and its faults: conv_id,
    gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.  Rows with n = 0 only name their
    conversation."""
    spark = rows.sparkSession
    bounded_batches(spark)
    kind = rows.schema[id_col].dataType.simpleString()
    rows = rows.withColumnRenamed(id_col, "conv_id")
    named = rows.select("conv_id").distinct()
    lines = _ordered(rows.where("n > 0"))
    head = _segments(lines.select("conv_id", "pos", "code", "n"))
    none = lambda t: F.lit(None).cast(t)
    stream = lines.select("conv_id", "pos", F.lit(2).alias("kind"), "turn", "role", "text", "n", "fault", "initial", none("array<string>").alias("audits"))
    for extra, what in ((head, 1), (named, 0)):
        cols = [F.col(c) if c in extra.columns else F.lit(-1).cast("long") if c == "pos" else F.lit(what) if c == "kind" else none(t) for c, t in stream.dtypes]
        stream = stream.union(extra.select(*(c.alias(f) for c, f in zip(cols, stream.columns, strict=True))))
    stream = stream.repartition("conv_id").sortWithinPartitions("conv_id", "pos", "kind")
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []

        def out(schema: pa.Schema) -> pa.RecordBatch:
            cols = list(zip(*done, strict=True))
            arrays = [pa.array(cols[0], schema.field(0).type), *(pa.array(c, pa.int64()) for c in cols[1:7]), *(pa.array(c, pa.string()) for c in cols[7:])]
            return pa.RecordBatch.from_arrays(arrays, ["conv_id", *names, "audit", "repaired_sha256"])

        schema = None
        for b in batches:
            schema = b.schema
            for conv, _, what, turn, role, text, n, fault, initial, audits in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if what == 0:
                    if now is not None:
                        done.append(now.done())
                    now = _Repair(conv)
                elif what == 1:
                    now.start(audits)
                else:
                    now.row(turn, role, text, n, fault, initial)
            if len(done) >= 1000:
                yield out(schema)
                done = []
        if now is not None:
            done.append(now.done())
        if done:
            yield out(schema)

    counts = ", ".join(f"{c} long" for c in names)
    return stream.mapInArrow(handing_back(run), f"conv_id {kind}, {counts}, audit string, repaired_sha256 string").withColumnRenamed("conv_id", id_col)


def damage_and_repair(conversations: DataFrame) -> DataFrame:
    """``repair`` of the damaged conversations: a row for every original conv_id, even if damage dropped all of it."""
    named = conversations.select("conv_id", F.lit(0).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(0).alias("n"))
    return repair(damage(conversations).union(named))
