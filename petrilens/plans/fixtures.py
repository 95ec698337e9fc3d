"""Fixtures: the given tables read as tables of objects, pixels, measurements and growth curves.

Only integer arithmetic and exact steps, so that Spark and SQL agree; each has its SQL beside it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    t, i, u = F.dayofmonth("ts") - 1, F.col("event_id"), F.col("user_id")
    o = e.select(
        t.cast("int").alias("t"), (i % 5).cast("int").alias("z"), i.alias("label"), (u * 100 + t).cast("long").alias("nucleus_3d_id"),
        ((u * 37) % 5600 + i % 7).cast("double").alias("centroid_x_px"), ((u * 53) % 3800 + i % 5).cast("double").alias("centroid_y_px"),
        (4000 + (i * 31) % 20000).cast("long").alias("area_px"), (50 + i % 20).cast("double").alias("_h"), (1 + (i % 50) / 100).alias("_f"),
    )
    o = o.withColumn("perimeter_px", 2 * F.sqrt(F.pi() * F.col("area_px")) * F.col("_f"))
    for name, base, sign in (("bbox_min_row", "centroid_y_px", -1), ("bbox_min_col", "centroid_x_px", -1), ("bbox_max_row", "centroid_y_px", 1), ("bbox_max_col", "centroid_x_px", 1)):
        o = o.withColumn(name, F.col(base) + sign * F.col("_h"))
    return o.drop("_h", "_f")


OBJECTS = """objects AS (SELECT t, z, label, nucleus_3d_id, centroid_x_px, centroid_y_px, area_px,
  2 * sqrt(pi() * area_px) * (1 + (label % 50) / 100.0::DOUBLE) AS perimeter_px,
  centroid_y_px - h AS bbox_min_row, centroid_x_px - h AS bbox_min_col, centroid_y_px + h AS bbox_max_row, centroid_x_px + h AS bbox_max_col
  FROM (SELECT (day(ts) - 1)::INT AS t, (event_id % 5)::INT AS z, event_id AS label, user_id * 100 + day(ts) - 1 AS nucleus_3d_id,
    ((user_id * 37) % 5600 + event_id % 7)::DOUBLE AS centroid_x_px, ((user_id * 53) % 3800 + event_id % 5)::DOUBLE AS centroid_y_px,
    4000 + (event_id * 31) % 20000 AS area_px, (50 + event_id % 20)::DOUBLE AS h FROM events))"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("p", "v"))
    i, p = F.col("vec_id"), F.col("p")
    return v.select(
        F.lit("s0").alias("stack_id"), F.floor(i / 100).cast("int").alias("t"), F.lit(0).alias("z"), F.lit(0).alias("c"),
        ((F.floor(i / 10) % 10) * 8 + F.floor(p / 8)).cast("int").alias("y"), ((i % 10) * 8 + p % 8).cast("int").alias("x"), F.col("v").cast("double").alias("intensity"),
    )


PIXELS = """pixels AS (SELECT 's0' AS stack_id, (vec_id // 100)::INT AS t, 0 AS z, 0 AS c, (((vec_id // 10) % 10) * 8 + p // 8)::INT AS y,
  ((vec_id % 10) * 8 + p % 8)::INT AS x, v::DOUBLE AS intensity
  FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS p FROM embeddings))"""


def probs(px: DataFrame) -> DataFrame:
    """Three class probabilities per pixel from its min-max intensity v: 1 - v, v and v^2 over their sum."""
    from petrilens.operators.summaries import min_max

    d = px.withColumn("v", min_max("intensity", ["stack_id", "t", "z", "c"]))
    three = F.array(1 - F.col("v"), F.col("v"), F.col("v") * F.col("v"))
    d = d.withColumn("_s", 1 + F.col("v") * F.col("v"))
    return d.select("stack_id", "t", "z", "y", "x", F.posexplode(three).alias("class_id", "_p"), "_s").select("stack_id", "t", "z", "y", "x", "class_id", (F.col("_p") / F.col("_s")).alias("prob"))


PROBS = """probs AS (SELECT stack_id, t, z, y, x, class_id, (CASE class_id WHEN 0 THEN 1 - v WHEN 1 THEN v ELSE v * v END) / (1 + v * v) AS prob
  FROM (SELECT *, CASE WHEN mx > mn THEN (intensity - mn) / (mx - mn) ELSE 0 END AS v FROM
    (SELECT *, min(intensity) OVER (PARTITION BY t) AS mn, max(intensity) OVER (PARTITION BY t) AS mx FROM pixels)), (VALUES (0), (1), (2)) AS k(class_id))"""


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    cond = F.when(F.col("l_returnflag") == "A", "Control").when(F.col("l_returnflag") == "N", "P150").otherwise("CDR2")
    return l.select(
        cond.alias("Condition"), F.col("l_quantity").alias("Time"), F.col("l_extendedprice").alias("Nuclear_Area"), (F.col("l_discount") * 10).alias("N_C_V2"),
        (F.col("l_tax") * 1000).alias("Nuclear_Membrane_BG_Subtracted"), F.col("l_suppkey").alias("cluster"), F.col("l_linenumber").alias("Slice"), F.col("l_orderkey").alias("row_key"),
    )


MEASUREMENTS = """measurements AS (SELECT CASE l_returnflag WHEN 'A' THEN 'Control' WHEN 'N' THEN 'P150' ELSE 'CDR2' END AS Condition, l_quantity AS Time,
  l_extendedprice AS Nuclear_Area, l_discount * 10 AS N_C_V2, l_tax * 1000 AS Nuclear_Membrane_BG_Subtracted, l_suppkey AS cluster, l_linenumber AS Slice, l_orderkey AS row_key FROM lineitem)"""


def growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    cond = F.when(F.col("l_returnflag") == "A", "Control").when(F.col("l_returnflag") == "N", "P150").otherwise("CDR2")
    area = 300 * F.col("l_quantity") / (F.col("l_quantity") + 15) + F.col("l_extendedprice") % 40 - 20
    return l.select(cond.alias("Condition"), F.col("l_quantity").alias("Time"), area.alias("Nuclear_Area"), F.col("l_orderkey").alias("row_key"), F.col("l_linenumber").alias("Slice"))


GROWTH = """growth AS (SELECT CASE l_returnflag WHEN 'A' THEN 'Control' WHEN 'N' THEN 'P150' ELSE 'CDR2' END AS Condition, l_quantity AS Time,
  300 * l_quantity / (l_quantity + 15) + l_extendedprice % 40 - 20 AS Nuclear_Area, l_orderkey AS row_key, l_linenumber AS Slice FROM lineitem)"""


def fiji_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, p = table(spark, sf_dir, "lineitem"), F.col("l_extendedprice")  # noqa: E741
    return l.select(
        p.alias("Area"), (p * (2 + F.col("l_tax"))).alias("IntDen"), (p * (1 + F.col("l_discount"))).alias("m_IntDen"), (p * (1 + F.col("l_tax"))).alias("npc_IntDen"), (2 + F.col("l_tax")).alias("Mean"),
        ((F.col("l_suppkey") * 61) % 5732).cast("double").alias("XM"), ((F.col("l_suppkey") * 43) % 3890).cast("double").alias("YM"), F.col("l_linenumber").alias("Slice"), F.col("l_orderkey").alias("row_key"), F.col("l_suppkey").alias("suppkey"),
    )


FIJI = """fiji AS (SELECT l_extendedprice AS Area, l_extendedprice * (2 + l_tax) AS IntDen, l_extendedprice * (1 + l_discount) AS m_IntDen, l_extendedprice * (1 + l_tax) AS npc_IntDen, 2 + l_tax AS Mean,
  ((l_suppkey * 61) % 5732)::DOUBLE AS XM, ((l_suppkey * 43) % 3890)::DOUBLE AS YM, l_linenumber AS Slice, l_orderkey AS row_key, l_suppkey AS suppkey FROM lineitem)"""


def replicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return o.join(k, o.o_custkey == k.c_custkey).select(F.col("c_mktsegment").alias("condition"), F.col("o_orderpriority").alias("replicate"), F.col("o_totalprice").alias("value"))


REPLICATES = """replicates AS (SELECT c_mktsegment AS condition, o_orderpriority AS replicate, o_totalprice AS value FROM orders JOIN customer ON o_custkey = c_custkey)"""
