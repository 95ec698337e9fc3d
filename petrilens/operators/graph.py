"""Connected components and chain ids over edge tables."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as ``spark.checkpoint.dir`` of the session names it.  Where a session on one
    machine names none (tests), a fresh temporary folder is set; on a cluster that is an error."""
    context, named = spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or f"file://{tempfile.mkdtemp(prefix='spark-')}")
    return named or context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows from a checkpoint in the shared folder: lineage ends, and an executor's loss costs nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def packed(df: DataFrame, rows: int = 100_000) -> tuple[DataFrame, int]:
    """``df`` (narrow rows) from a checkpoint, in as few partitions as its rows need at ``rows`` each, and their number,
    which the job that writes the checkpoint counts.  A small result of a shuffle then costs later steps a task or two
    instead of one for each of its mostly empty partitions; a large one stays as it was dealt."""
    seen = Observation()
    held = cut(df.observe(seen, F.count(F.lit(1)).alias("n")))
    n = seen.get.get("n")
    n = held.count() if n is None else n
    parts = max(1, -(-n // rows))
    return (held.coalesce(parts) if parts < held.rdd.getNumPartitions() else held), n


def _mark(df: DataFrame, *cols: str):
    return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*cols).cast("decimal(38,0)"))).head())


#: Edges up to which the rest of a graph is tied in one task, without any exchange.
_FEW = 100_000
#: At most so many keys are split off as hot: those that have more than this part of the rows.
_HOT = 5_000


def join_one(left: DataFrame, right: DataFrame, key: str, n: int) -> DataFrame:
    """``left`` (of ``n`` rows) joined with ``right``, which has one row a key.  Keys with more than n / ``_HOT`` rows (a
    hub and its neighbours) stay where they lie: their rows of ``right``, fewer than ``_HOT``, are broadcast to them."""
    if n <= _FEW:
        return left.join(right, key)
    hot = left.groupBy(key).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > n // _HOT).select(key)
    light = left.join(F.broadcast(hot), key, "left_anti").join(right, key)
    return light.unionByName(left.join(F.broadcast(right.join(F.broadcast(hot), key, "left_semi")), key))


def _tie_few(edges: DataFrame) -> DataFrame:
    """(node, component) for at most ``_FEW`` edges (x, y) of one partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        up: dict = {}

        def top(v):
            while up.setdefault(v, v) != v:
                up[v] = v = up[up[v]]
            return v

        for batch in batches:
            for x, y in zip(batch["x"], batch["y"], strict=True):
                x, y = top(x), top(y)
                up[max(x, y)] = min(x, y)
        yield pd.DataFrame({"node": list(up), "component": [top(v) for v in up]})

    kind = edges.schema["x"].dataType.simpleString()
    return edges.mapInPandas(run, f"node {kind}, component {kind}")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): every node of the edges with the least node it reaches.

    Each round ties a node's larger neighbours, then its smaller ones, to its least neighbour; the longest path about
    halves, and a checkpoint ends the round's lineage.  A hub is no hot key (see ``join_one``).  At most ``_FEW`` edges
    (counted) between whole numbers or strings need no rounds: one task ties them.
    """
    e, n = packed(edges.select(F.least(a, b).alias("x"), F.greatest(a, b).alias("y")).distinct())
    loops = e.where("x = y").select(F.col("x").alias("node"), F.col("x").alias("component"))
    now = e.where("x < y")
    if n <= _FEW and now.schema["x"].dataType.simpleString() in ("int", "bigint", "string"):
        tied = cut(_tie_few(now.coalesce(1)))
        return tied.union(loops.join(tied.select("node"), "node", "left_anti"))
    seen = _mark(now, "x", "y")
    pair = lambda p, q, p_name, q_name: F.struct(p.alias(p_name), q.alias(q_name))
    while True:
        x, y, m = F.col("x"), F.col("y"), F.col("m")
        both = now.select(F.inline(F.array(pair(x, y, "u", "v"), pair(y, x, "u", "v"))))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        up = join_one(both.where("v > u"), least, "u", seen[0]).select(m.alias("x"), F.col("v").alias("y")).where("x < y").distinct()
        low = up.groupBy("y").agg(F.min("x").alias("m"))
        tied = join_one(up, low, "y", seen[0]).select(F.inline(F.array(pair(m, y, "x", "y"), pair(m, x, "x", "y"))))
        now = cut(tied.where("x < y").distinct())
        last, seen = seen, _mark(now, "x", "y")
        if seen == last:
            break
    tied = now.select(F.col("y").alias("node"), F.col("x").alias("component")).union(now.select(F.col("x").alias("node"), F.col("x").alias("component")).distinct())
    return tied.union(loops.join(tied.select("node"), "node", "left_anti"))


#: Edges of neighbours that one call ties.
_NEAR = 200_000


def tie(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct nodes of the edges a - b, and the least node each reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, up = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        low, high = np.minimum(up[x], up[y]), np.maximum(up[x], up[y])
        open_ = low < high
        if not open_.any():
            return nodes, nodes[up]
        x, y = x[open_], y[open_]
        np.minimum.at(up, high[open_], low[open_])
        while (up[up] != up).any():
            up = up[up]


def connected_neighbours(edges: DataFrame, place: Sequence[str], a: str = "a", b: str = "b") -> DataFrame:
    """``connected_components`` of edges between whole numbers that tie neighbours: edges near each other in the order of
    ``place`` fall into the same call, which ties up to ``_NEAR`` of them to their least nodes.  What is left is the graph
    of those least nodes, tied by the nodes that several calls met."""
    rows = edges.select(*place, F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            node, least = tie(*(np.concatenate([h.column(c).to_numpy(zero_copy_only=False) for h in held]) for c in ("a", "b")))
            return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(least, pa.int64())], ["node", "least"])

        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= _NEAR:
                yield told(held)
                held, n = [], 0
        if n:
            yield told(held)

    near = rows.repartitionByRange(*place).sortWithinPartitions(*place).select("a", "b").mapInArrow(run, "node long, least long")
    met = cut(near.groupBy("node").agg(F.min("least").alias("least"), F.collect_set("least").alias("all")))
    return met.select("node", "least").join(tied_calls(met), "least", "left").select("node", F.coalesce("component", "least").alias("component"))


def tied_calls(met: DataFrame) -> DataFrame:
    """(least, component) for the least nodes of several calls that met in a node of ``met(least, all)``: its least node of
    any call and those of all calls."""
    between = met.where("size(all) > 1").select(F.col("least").alias("a"), F.explode("all").alias("b")).where("a < b")
    return connected_components(between).select(F.col("node").alias("least"), "component")


def components_of(nodes: DataFrame, edges: DataFrame, key: str, out: str, a: str = "a", b: str = "b") -> DataFrame:
    """``nodes`` with ``out``: the least key of the row's component, its own key without an edge."""
    c = connected_components(edges, a, b).select(F.col("node").alias("_node"), F.col("component").alias("_component"))
    return nodes.join(c, F.col(key) == F.col("_node"), "left").withColumn(out, F.coalesce("_component", key)).drop("_node", "_component")


def chain_heads(links: DataFrame, child: str, parent: str) -> DataFrame:
    """(node, head) for every node of a forest given by links child -> parent: the root it leads to.  Pointers double
    each round, so the rounds are the logarithm of the longest chain."""
    nodes = links.select(F.col(child).alias("node"), F.col(parent).alias("up"))
    roots = links.select(F.col(parent).alias("node")).distinct().join(nodes.select("node"), "node", "left_anti")
    now = cut(nodes.union(roots.select("node", F.col("node").alias("up"))))
    seen = _mark(now, "node", "up")
    while True:
        above = now.select(F.col("node").alias("up"), F.col("up").alias("_u"))
        now = cut(join_one(now, above, "up", seen[0]).select("node", F.col("_u").alias("up")))
        last, seen = seen, _mark(now, "node", "up")
        if seen == last:
            return now.select("node", F.col("up").alias("head"))


def in_order(df: DataFrame, order: Sequence[str], out: str) -> DataFrame:
    """``df`` with ``out``: its place 0, 1, ... in the order of the columns.  Rows are numbered per range partition and offset
    by the partitions before, so no task sees them all."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = cut(rows.withColumn("_part", F.spark_partition_id()).withColumn("_n", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_k"))
    before = sizes.alias("a").join(F.broadcast(sizes.alias("b")), F.col("b._part") < F.col("a._part"), "left").groupBy("a._part").agg(F.coalesce(F.sum("b._k"), F.lit(0)).alias("_off"))
    return rows.join(F.broadcast(before), "_part").withColumn(out, F.col("_n") + F.col("_off")).drop("_part", "_n", "_off")


def dense_ids(df: DataFrame, head: str, out: str) -> DataFrame:
    """``df`` with ``out``: 1, 2, ... in the order of the heads."""
    numbered = in_order(df.select(F.col(head).alias("_h")).distinct(), ["_h"], "_id").select("_h", (F.col("_id") + 1).alias(out))
    return df.join(numbered, F.col(head) == F.col("_h")).drop("_h")
