"""Adjusted p values and cluster ranks on large groups and odd rows."""

import time

from pyspark.sql import functions as F

from petrilens.operators import compare


def test_adjusted_p_of_a_large_family(spark):
    """Equal and distinct p values; a window from each row to the end took time with the square of a family's rows."""
    n = 120_000
    d = spark.range(n).select(F.col("id").alias("k"), F.lit(None).cast("string").alias("f"), ((F.col("id") * 7919 % n) / n).alias("p"))
    d = d.union(d.where("k < 3").selectExpr("k + 1000000", "f", "cast(null as double)"))
    start = time.time()
    got = compare.adjust_bh(d, ["f"], "p", ["k"]).agg(F.count("p_adj"), F.count(F.lit(1)), F.max("p_adj"), F.min("p_adj")).first()
    assert tuple(got) == (n, n + 3, (n - 1) / n, 0.0)
    assert time.time() - start < 30


def test_adjusted_p_of_equal_values(spark):
    d = spark.createDataFrame([(1, "a", 0.01), (2, "a", 0.02), (3, "a", 0.02), (4, "a", 0.9), (5, "a", None)], "k int, f string, p double")
    got = {r["k"]: r["p_adj"] for r in compare.adjust_bh(d, ["f"], "p").collect()}
    assert got[2] == got[3] == 0.02 * 4 / 3 and got[1] == min(0.04, got[2]) and got[4] == 0.9 and got[5] is None


def test_halo_rank_multiplies_before_it_divides(spark):
    """As in its SQL: the other order gives 256.35000000000036, which rounds to another tenth."""
    areas = [1198.72, 1300.0, 1400.0, 1500.0, 6408.75, 7000.0, 7100.0, 7200.0]
    rows = [(1, a, a * 3, a * (1 + (0.04 if i == 0 else 0.08)), a, 2.0, 1.0, 1.0, 1, i) for i, a in enumerate(areas)]
    d = spark.createDataFrame(rows, "c int, Area double, IntDen double, m_IntDen double, npc_IntDen double, Mean double, XM double, YM double, Slice int, row_key int")
    q1, q5 = rows[0][3], rows[4][3]
    want = (q5 - q1) - (areas[4] - areas[0]) * q1 / areas[0]
    assert compare.halo_rank(d, cluster="c", px_per_um=6.0, key=["row_key", "Slice"]).first()["Nuclear_Membrane"] == want == 256.34999999999945


def test_trajectories_keep_near_suppliers_apart(spark, tmp_path):
    """Two suppliers on one spot; each has its own trajectory, as in the SQL."""
    from petrilens.plans import statistics

    keys = [0, 5732 * 3890 // 2]
    rows = [(k, k, 1, 10.0 + i, 0.0, 0.0, "A", 1.0) for i, k in enumerate(keys)]
    spark.createDataFrame(rows, "l_orderkey long, l_suppkey long, l_linenumber int, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert sorted(r["suppkey"] for r in statistics.Q["trajectories"](spark, str(tmp_path)).collect()) == keys
