"""Best-fit packing of token sequences: the configuration linear program over the histogram of lengths.

A configuration is a multiset of lengths that fits a sequence; the program asks for the fewest configurations that
cover every length as often as it occurs.  ``fractional_cover`` solves it by multiplicative weights: each length has a
price, starting at its share of a sequence; a knapsack (dynamic programming over the room, ``price``) gives for every
length the dearest configuration that holds it; those of the lengths covered least are used by a small part of the
demand, and a length's price falls by a factor as it is covered.  ``round_cover`` takes the whole part of the uses and
lays what is left by best fit.

Scale: the program sees one number a length (at most ``size`` of them), whatever the number of documents; it runs on
the driver in bounded time.  Documents are encoded once, their pieces written as a table; a piece gets its rank among
the pieces of its length from its task's running count and the counts of the tasks before, so a length that a third of
all pieces have is no hot key.  The slots of the configurations are a table bounded by ``size`` and the number of
configurations, not by the documents.

Rows: a null text counts as an empty one (the end id alone); null and repeated ids are packed row by row; an empty
table gives no rows; columns beside the two named ones are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from petrilens.llm.common import bounded_batches, fresh_path, handing_back
from petrilens.llm.token_files import Encoder

Configuration = tuple[tuple[int, int], ...]  #: (length, copies), the longest first


def price(values: np.ndarray, stock: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack over lengths 1 to ``size`` (index 0 unused): best[r], the highest value that fits the room r, and the
    length that a best filling of r takes last (the longest such), 0 where leaving a token free is as good.  Only
    lengths in stock."""
    usable = np.where(stock > 0, values, -1.0)
    best, last = np.zeros(size + 1), np.zeros(size + 1, np.int64)
    for r in range(1, size + 1):
        gain = best[:r] + usable[r:0:-1]  # length r - k leaves the room k
        at = int(gain.argmax())
        best[r] = best[r - 1]
        if gain[at] > best[r] + 1e-12:
            best[r], last[r] = gain[at], r - at
    return best, last


def _filling(last: np.ndarray, room: int, first: int, stock: np.ndarray) -> Configuration:
    """The configuration of ``first`` and a best filling of the rest of the room, within the stock."""
    held = Counter([first])
    room -= first
    while room > 0:
        length = int(last[room])
        if length and held[length] < stock[length]:
            held[length] += 1
            room -= length
        else:
            room -= 1
    return tuple(sorted(held.items(), reverse=True))


def fractional_cover(demand: np.ndarray, size: int, visits: int | None = None, width: int = 16, eta: float = 3.0, curve: float = 0.5) -> dict[Configuration, float]:
    """Uses of configurations that cover the demand (by length, index 0 unused) by multiplicative weights.

    The level of a length is the covered part of its demand.  A round prices the lengths by their share of a sequence
    (``curve`` prefers few long pieces to many short ones) times exp(-eta * level), solves the knapsack, and uses, for
    each of the ``width`` lengths of the lowest levels, the dearest configuration that holds it, for a ``visits``-th of
    the demand of its scarcest length (20, more for fewer than 50 lengths).  A covered length leaves the knapsack."""
    visits = visits or max(20, 1000 // max(1, np.count_nonzero(demand)))
    share, some = np.arange(size + 1) / size, np.maximum(demand, 1).astype(float)
    worth, level = share * (1 + curve * share), np.where(demand > 0, 0.0, 1.0)
    used: dict[Configuration, float] = {}
    while len(lacking := np.flatnonzero(level < 1 - 1e-9)):
        stock = np.where(level < 1 - 1e-9, demand, 0)
        _, last = price(worth * np.exp(-eta * level), stock, size)
        for length in lacking[np.argsort(level[lacking] - 1e-6 * lacking, kind="stable")][:width].tolist():
            if level[length] < 1 - 1e-9:
                c = _filling(last, size, length, stock)
                times = min(min(some[x] / visits, (1 - level[x]) * some[x]) / copies for x, copies in c)
                if times > 1e-12:
                    used[c] = used.get(c, 0.0) + times
                    for x, copies in c:
                        level[x] += times * copies / some[x]
    return used


def best_fit(left: np.ndarray, size: int) -> Counter:
    """Configurations for the lengths left: the longest first, each into the open sequence with the least room that
    holds it.  Sequences of the same content are one class with a count, so the work depends on the lengths alone."""
    open_: dict[int, Counter] = {}  # room -> content -> sequences
    for length in range(size, 0, -1):
        n = int(left[length])
        for room in [*sorted(r for r in open_ if length <= r < size), size]:
            fit = room // length  # a sequence that took one piece has the least room for the next
            moved: list[tuple[int, Counter]] = []
            for content in [()] if room == size else list(open_[room]):
                have = -(-n // fit) if room == size else open_[room][content]
                for copies, times in ((fit, min(have, n // fit)), (n % fit, 1)):
                    if copies and times and have and n >= copies * times and n:
                        moved.append((room - copies * length, Counter({(*content, (length, copies)): times})))
                        n, have = n - copies * times, have - times
                        if room < size:
                            open_[room][content] -= times
                if not n:
                    break
            for r, more in moved:
                open_.setdefault(r, Counter()).update(more)
            if room in open_:
                open_[room] = +open_[room]
            if not n:
                break
    return sum(open_.values(), Counter())


def round_cover(used: dict[Configuration, float], demand: np.ndarray, size: int) -> Counter:
    """Whole uses of configurations that hold the demand exactly: the whole part of each full configuration's uses, and
    best fit for what is left."""
    left, out = demand.astype(np.int64).copy(), Counter()
    for c, times in used.items():
        whole = min(int(times + 1e-6), *(int(left[length]) // copies for length, copies in c))
        if whole > 0 and sum(length * copies for length, copies in c) == size:
            out[c] += whole
            for length, copies in c:
                left[length] -= whole * copies
    return out + best_fit(left, size)


def configurations(demand: np.ndarray, size: int) -> list[tuple[Configuration, int]]:
    """Configurations and their whole uses that hold the demand exactly."""
    return sorted(round_cover(fractional_cover(demand, size), demand, size).items())


def pieces(docs: DataFrame, *, tokenizer: str, size: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Written as a table: doc_id, piece, start, length, ids (little-endian unsigned 32-bit), part (of the table) and
    nth (among the pieces of this length in the part)."""
    spark = docs.sparkSession
    bounded_batches(spark, 3000)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seen = Encoder(tokenizer), TaskContext.get().partitionId(), Counter()
        for b in batches:
            rows: list[tuple] = []
            for k, x in enumerate(encoder.encode_all(b.column(1))):
                ids = np.append(x, np.uint32(end_id)).astype("<u4")
                cuts = [0, *range(len(ids) % size or size, len(ids), size), len(ids)] if len(ids) > size else [0, len(ids)]
                for piece, (at, to) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    rows.append((k, piece, at, to - at, ids[at:to].tobytes(), seen[to - at]))
                    seen[to - at] += 1
            if rows:
                which, piece, start, length, ids, nth = zip(*rows, strict=True)
                cols = [b.column(0).take(pa.array(which, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(c, pa.int64()) for c in (start, length)), pa.array(ids, pa.binary()), pa.array([part] * len(rows), pa.int32()), pa.array(nth, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "piece", "start", "length", "ids", "part", "nth"])

    made = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    made = made.mapInArrow(handing_back(run), f"doc_id {kind}, piece int, start long, length long, ids binary, part int, nth long")
    path = fresh_path(spark, "pieces")
    made.write.parquet(path)
    return spark.read.schema(made.schema).parquet(path)


def pack(docs: DataFrame, *, tokenizer: str, size: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", carry: Column | None = None) -> DataFrame:
    """Every piece of every document with its place: doc_id, piece, start, length, ids, sequence_id, offset.  Documents
    of more than ``size`` ids are cut to pieces of ``size``, the first one perhaps shorter.  ``carry``, a column made of
    ids, stands for them where it is enough, so that the join with the places moves narrow rows."""
    spark = docs.sparkSession
    carry = F.col("ids") if carry is None else carry
    written = pieces(docs, tokenizer=tokenizer, size=size, end_id=end_id, id_col=id_col, text_col=text_col)
    made = written.select("doc_id", "piece", "start", "length", "part", "nth", carry)
    carried = [c for c in made.columns if c not in written.columns or c == "ids"]
    counts = made.groupBy("part", "length").agg(F.count(F.lit(1)).alias("k"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "length", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("base"))
    demand = np.zeros(size + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("k").alias("k")).collect():  # at most ``size`` rows
        demand[r["length"]] = r["k"]
    full, demand[size] = int(demand[size]), 0
    slots, first, taken = [(size, 0, full, 0, 1, 0)], full, Counter()
    for c, times in configurations(demand, size):
        offset = 0
        for length, copies in c:
            slots.append((length, taken[length], taken[length] + times * copies, first, copies, offset))
            taken[length] += times * copies
            offset += length * copies
        first += times
    table = spark.createDataFrame(slots, "length long, low long, high long, first long, copies long, offset_1 long")
    rank = F.col("base") + F.col("nth")
    place = F.col("rank") - F.col("low")
    ranked = made.join(base, ["part", "length"]).withColumn("rank", rank)
    found = ranked.join(F.broadcast(table), (ranked["length"] == table["length"]) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))).drop(table["length"])
    sequence = F.col("first") + F.floor(place / F.col("copies")).cast("long")
    return found.select("doc_id", "piece", "start", "length", *carried, sequence.alias("sequence_id"), (F.col("offset_1") + place % F.col("copies") * F.col("length")).alias("offset"))
