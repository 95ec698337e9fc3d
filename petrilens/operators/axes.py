"""Axis operators on pixel tables: concatenation, splitting, extraction, layers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

AXES = ("t", "z", "c", "y", "x")


def stack_summary(px: DataFrame, stack: str = "stack_id") -> DataFrame:
    """Per stack: size of each axis, pixels, least and largest intensity."""
    sizes = [(F.max(a) + 1).alias(f"size_{a}") for a in AXES if a in px.columns]
    return px.groupBy(stack).agg(*sizes, F.count(F.lit(1)).alias("n_pixels"), F.min("intensity").alias("min"), F.max("intensity").alias("max"))


def concat_stacks(px: DataFrame, jobs: DataFrame, axis: str = "t") -> DataFrame:
    """Stacks laid end to end along an axis: ``jobs(job, order, stack_id)``.  The other axes must agree inside a job;
    a job whose stacks don't raises an error."""
    others = [a for a in AXES if a != axis]
    s = jobs.join(stack_summary(px), "stack_id")
    w = Window.partitionBy("job")
    same = None
    for a in others:
        ok = F.min(f"size_{a}").over(w) == F.max(f"size_{a}").over(w)
        same = ok if same is None else same & ok
    upto = w.orderBy("order").rowsBetween(Window.unboundedPreceding, -1)
    off = s.withColumn("_ok", same).withColumn("_off", F.coalesce(F.sum(f"size_{axis}").over(upto), F.lit(0)))
    off = off.withColumn("_off", F.when(F.col("_ok"), F.col("_off")).otherwise(F.raise_error(F.concat(F.lit("shapes differ in job "), F.col("job").cast("string"))).cast("long")))
    d = px.join(off.select("job", "stack_id", "_off"), "stack_id")
    return d.withColumn(axis, F.col(axis) + F.col("_off")).withColumn("stack_id", F.col("job")).drop("job", "_off")


def concat_from_manifest(px: DataFrame, manifest: DataFrame, axis: str = "t") -> tuple[DataFrame, DataFrame]:
    """Concatenation by a manifest (experiment_id, order, input_file, output_file), and a log row per experiment:
    n_inputs, status, error.  Experiments with a missing input or differing shapes have status error and no pixels."""
    s = stack_summary(px).withColumnRenamed("stack_id", "_s")
    j = manifest.join(s, F.col("input_file") == F.col("_s"), "left")
    others = [a for a in AXES if a != axis]
    differ = F.greatest(*[(F.max(f"size_{a}") - F.min(f"size_{a}")) for a in others]) > 0
    log = j.groupBy("experiment_id", "output_file").agg(F.count(F.lit(1)).alias("n_inputs"), F.count_if(F.col("_s").isNull()).alias("_missing"), differ.alias("_differ"))
    error = F.when(F.col("_missing") > 0, F.concat(F.col("_missing").cast("string"), F.lit(" inputs missing"))).when(F.col("_differ"), F.lit("shapes differ"))
    log = log.withColumn("error", error).withColumn("status", F.when(error.isNull(), "ok").otherwise("error")).drop("_missing", "_differ")
    good = manifest.join(log.where("status = 'ok'").select("experiment_id"), "experiment_id", "left_semi")
    jobs = good.select(F.col("output_file").alias("job"), "order", F.col("input_file").alias("stack_id"))
    return concat_stacks(px, jobs, axis), log


def split_blocks(px: DataFrame, size: int, axis: str = "t") -> DataFrame:
    """Adds part = axis div size and counts the axis anew inside it; write with partitionBy("part")."""
    return px.withColumn("part", F.floor(F.col(axis) / size).cast("int")).withColumn(axis, F.col(axis) % size)


def extract(px: DataFrame, axis: str, index: int) -> DataFrame:
    """One channel, frame or plane, without its axis."""
    return px.where(F.col(axis) == index).drop(axis)


def deinterleave(px: DataFrame, n: int, axis: str = "t") -> DataFrame:
    """Adds stream = axis mod n and divides the axis by n."""
    return px.withColumn("stream", F.col(axis) % n).withColumn(axis, F.floor(F.col(axis) / n).cast("int"))


def ensure_axes(px: DataFrame, value: str = "intensity", stack: str = "stack_id") -> DataFrame:
    """All axes, missing ones 0; a column that is no axis is an error."""
    unknown = [c for c in px.columns if c not in (*AXES, value, stack)]
    if unknown:
        raise ValueError(f"unknown axes {unknown}")
    for a in AXES:
        if a not in px.columns:
            px = px.withColumn(a, F.lit(0))
    return px.select(*[c for c in (stack,) if c in px.columns], *AXES, value)


def layers_to_long(wide: DataFrame, layers: DataFrame, name: str = "layer", keys: Sequence[str] = ("y", "x")) -> DataFrame:
    """Long pixel table of a wide one (``keys`` and a column per layer) joined to ``layers(layer, ...)``.  A layer without
    a row, or a row without a layer, is an error."""
    cols = [c for c in wide.columns if c not in keys]
    listed = {r[name] for r in layers.select(name).collect()}  # one row a column
    if set(cols) != listed:
        raise ValueError(f"layers don't match: {sorted(set(cols) ^ listed)}")
    return wide.unpivot(list(keys), cols, name, "intensity").join(F.broadcast(layers), name)


def layer_grid(spark, sizes: dict[str, int]) -> DataFrame:
    """Every combination of indices, and a layer name such as t0_z1_c2."""
    d = None
    for a, n in sizes.items():
        one = spark.range(n).select(F.col("id").cast("int").alias(a))
        d = one if d is None else d.crossJoin(one)
    return d.withColumn("layer", F.concat_ws("_", *[F.concat(F.lit(a), F.col(a).cast("string")) for a in sizes]))


def parse_layer(name, axis: str):
    """The number behind an axis letter in a layer name, null without one."""
    return F.regexp_extract(name, f"{axis}([0-9]+)", 1).try_cast("int")


def check_sizes(px: DataFrame, expected: Sequence[tuple[str, int]]) -> DataFrame:
    """Stacks whose axes don't have the expected sizes."""
    s = stack_summary(px)
    cond = F.lit(False)
    for a, n in expected:
        cond = cond | (F.col(f"size_{a}") != n)
    return s.where(cond)
