"""Mixing sources to target weights by Sainte-Lague apportionment of equal-word blocks.

Every source's documents are dealt by a seeded hash into shards and put in seeded order; a shard's word stream is cut
into blocks of ``block_words`` words.  The blocks the mix needs are apportioned to sources, and each source's blocks to
its shards, by highest quotients ``weight / (2 * seat - 1)``; a shard then takes its integer quota as whole passes plus
a run of blocks that starts at a seeded block.  Only DataFrame operations are used.

Rows: nulls in the text count as an empty text, null is a source of its own (the last one), rows that repeat are mixed
as documents of their own, an empty table gives no rows, and other columns of the input never matter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from petrilens.llm.common import WORD, cut, maybe_broadcast, n_words

_WIDE = "decimal(38,0)"


def source_targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), share: tuple[int, int] = (3, 2), most: int = 2) -> DataFrame:
    """Per source of ``sizes(source, size)``: source, source_size, target.

    Sources by code point, null last, have the weights in turn and share ``share`` of all words; a target stops at
    ``most`` times its source's size and the excess goes to the others by weight.  The level at which this ends is
    found in one pass over sources ordered by capacity per unit of weight.
    """
    every = Window.partitionBy()
    by_name = every.orderBy(F.col("source").isNull(), "source")
    by_room = every.orderBy(F.col("_cap") / F.col("_w"), "_k")
    src = (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("_k", F.row_number().over(by_name))
        .withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("_k") - 1, F.lit(len(weights))) + 1).cast("int")).cast("long"))
        .withColumn("_cap", F.col("source_size") * most)
        .withColumn("_all", F.sum("source_size").over(every) * share[0])
        .withColumn("_rank", F.row_number().over(by_room))
        .withColumn("_full", F.coalesce(F.sum("_cap").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("_rest", F.sum("_w").over(by_room.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_left", F.col("_all") - share[1] * F.col("_full"))
    )
    fits = F.col("_w").cast(_WIDE) * F.col("_left").cast(_WIDE) <= (share[1] * F.col("_rest")).cast(_WIDE) * F.col("_cap").cast(_WIDE)
    src = src.withColumn("_level", F.min(F.when(fits, F.struct("_rank", "_left", "_rest"))).over(every))
    below = F.coalesce(F.col("_rank") >= F.col("_level._rank"), F.lit(False))
    level = (F.col("_w") * F.col("_level._left")).cast("double") / (share[1] * F.col("_level._rest")).cast("double")
    return src.select("source", "source_size", F.when(below, level).otherwise(F.col("_cap").cast("double")).alias("target"), F.col("_k").alias("source_no"))


def apportion(df: DataFrame, group: Sequence[str], weight: str, seats: Column, tie: str, out: str) -> DataFrame:
    """Adds ``out``: each row's seats when its group's ``seats`` are dealt by highest quotients weight / (2k - 1).

    Rounded fair shares miss the number of seats by half the group's rows at most; that rest goes to the highest
    quotients above them or is taken from the lowest ones they hold.  A row can move by its part of that rest and one
    seat more, so a bounded number of quotients per row is ranked.  Ties go to the smaller ``tie``.
    """
    g = Window.partitionBy(*group)
    base = (
        df.withColumn("_seats", seats)
        .withColumn("_sum", F.sum(weight).over(g).cast("double"))
        .withColumn("_n", F.count(F.lit(1)).over(g))
        .withColumn("_part", F.when(F.col("_sum") > 0, F.col(weight).cast("double") / F.col("_sum")).otherwise(0.0))
        .withColumn("_base", F.floor(F.col("_part") * F.col("_seats") + 0.5))
        .withColumn("_miss", F.col("_seats") - F.sum("_base").over(g))
        .withColumn("_try", (F.floor(F.col("_part") * F.col("_n") / 2) + 2).cast("long"))
    )
    near = base.filter("_miss <> 0").select(*group, tie, weight, "_base", "_miss", F.explode(F.sequence(F.lit(1), "_try")).alias("_j"))
    up = F.col("_miss") > 0
    near = near.withColumn("_seat", F.when(up, F.col("_base") + F.col("_j")).otherwise(F.col("_base") + 1 - F.col("_j"))).filter("_seat > 0")
    near = near.withColumn("_q", F.col(weight).cast("double") / (2 * F.col("_seat") - 1))
    order = Window.partitionBy(*group).orderBy(F.when(up, -F.col("_q")).otherwise(F.col("_q")), F.when(up, F.col(tie)).otherwise(-F.col(tie)), F.when(up, F.col("_seat")).otherwise(-F.col("_seat")))
    moved = near.withColumn("_at", F.row_number().over(order)).filter(F.col("_at") <= F.abs("_miss")).groupBy(*group, tie).agg(F.count(F.lit(1)).alias("_moved"))
    moved = moved.select(*[F.col(c).alias(f"_m_{c}") for c in (*group, tie)], "_moved")
    on = [F.col(c) == F.col(f"_m_{c}") for c in (*group, tie)]
    total = F.col("_base") + F.signum(F.col("_miss").cast("double")).cast("long") * F.coalesce("_moved", F.lit(0))
    return base.join(moved, on, "left").select(*df.columns, total.cast("long").alias(out))


def _digits(seed: str, *cols: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]))


def _number(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def mix_plan(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    carry: Sequence[str] = (),
    weights: Sequence[int] = (5, 2, 1),
    share: tuple[int, int] = (3, 2),
    most: int = 2,
    block_words: int = 64,
    shard_words: int = 1 << 18,
    max_shards: int = 8192,
    seed: str = "mix",
) -> DataFrame:
    """Per row of ``docs``: doc_id, source, size, source_size, target, passes, runs, taken, and the columns in ``carry`` under ``_c_<name>``.

    ``passes`` counts whole takes of the document's words; ``runs`` lists the (first word, words) it gives besides.
    ``taken`` sums both and is at most ``most`` times ``size``.  A source's shards grow with its words, so that one
    window sorts about ``shard_words`` words (past ``max_shards`` shards, evenly more).
    """
    kept = [F.col(c).alias(f"_c_{c}") for c in carry]
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), F.when(F.col(id_col).isNull(), F.md5(F.coalesce(F.col(text_col), F.lit("")))).alias("_salt"), *kept)
    if not carry:
        sized = cut(sized)
    src = cut(source_targets(sized, weights, share, most))
    blocks = F.floor(F.sum("target").over(Window.partitionBy()) / block_words + 0.5)
    src = src.withColumn("_one", F.lit(1))
    src = cut(apportion(src, ["_one"], "target", blocks, "source_no", "source_blocks").drop("_one"))
    src = src.withColumn("n_shards", F.least(F.lit(max_shards), F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words))))
    s = maybe_broadcast(src.select(F.col("source").alias("_s"), "source_no", "source_size", "target", "source_blocks", "n_shards"))
    key = _digits(seed, F.coalesce(F.col("doc_id").cast("string"), F.col("_salt")))  # null ids are dealt by their text
    rows = sized.join(s, F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumn("_key", key)
    rows = rows.withColumn("shard", F.pmod(_number(F.col("_key")), F.col("n_shards")))
    shards = rows.groupBy("source_no", "shard").agg(F.sum("size").alias("shard_size"), F.first("source_blocks").alias("source_blocks"))
    shards = apportion(shards, ["source_no"], "shard_size", F.col("source_blocks"), "shard", "quota")
    n = F.greatest(F.lit(1), F.ceil(F.col("shard_size") / block_words))
    shards = (
        shards.withColumn("_n", n)
        .withColumn("quota", F.least("quota", F.col("_n") * most))
        .withColumn("passes", F.expr("quota div _n"))
        .withColumn("_rest", F.expr("quota % _n"))
        .withColumn("_from", F.pmod(_number(_digits(seed, F.col("source_no"), F.col("shard"))), F.col("_n")))
        .select(F.col("source_no").alias("_sn"), F.col("shard").alias("_sh"), "passes", (F.col("_from") * block_words).alias("_a"), (F.least(F.col("_from") + F.col("_rest"), F.col("_n")) * block_words).alias("_b"), (F.greatest(F.col("_from") + F.col("_rest") - F.col("_n"), F.lit(0)) * block_words).alias("_w"))
    )
    shards = maybe_broadcast(cut(shards))
    in_order = Window.partitionBy("source_no", "shard").orderBy(F.substring("_key", 9, 24), "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_end", F.sum("size").over(in_order)).withColumn("_at", F.col("_end") - F.col("size"))
    rows = rows.join(shards, (F.col("source_no") == F.col("_sn")) & (F.col("shard") == F.col("_sh")))

    def run(lo: Column, hi: Column) -> Column:
        first = F.greatest(F.col("_at"), lo)
        return F.struct((first - F.col("_at")).alias("first"), F.greatest(F.least(F.col("_end"), hi) - first, F.lit(0)).alias("words"))

    runs = F.filter(F.array(run(F.lit(0), F.col("_w")), run(F.col("_a"), F.col("_b"))), lambda r: r["words"] > 0)
    rows = rows.withColumn("runs", runs)
    taken = F.col("passes") * F.col("size") + F.aggregate("runs", F.lit(0).cast("long"), lambda a, r: a + r["words"])
    return rows.select("doc_id", "source", "size", "source_size", "target", "passes", "runs", taken.alias("taken"), *[F.col(f"_c_{c}") for c in carry])


def mix(docs: DataFrame, **params) -> DataFrame:
    """The mixed corpus with the columns of ``docs``: one row per whole take of a document, and one per run of its
    words (joined by one space) where the mix takes a part only; documents with nothing taken have no row.  Where
    a column ``n_chars`` stands beside the text it is counted anew."""
    text = params.get("text_col", "text")
    plan = mix_plan(docs, carry=docs.columns, **params)
    whole = F.transform(F.sequence(F.lit(1), F.lit(params.get("most", 2))), lambda i: F.when(i <= F.col("passes"), F.struct(F.lit(0).cast("long").alias("first"), F.col("size").alias("words"))))
    takes = F.concat(F.filter(whole, lambda r: r.isNotNull() & (r["words"] > 0)), F.col("runs"))
    out = plan.withColumn("_take", F.explode(takes))
    words = F.regexp_extract_all(F.col(f"_c_{text}"), F.lit(WORD), 0)
    part = F.array_join(F.slice(words, (F.col("_take.first") + 1).cast("int"), F.col("_take.words").cast("int")), " ")
    out = out.withColumn(f"_c_{text}", F.when(F.col("_take.words") == F.col("size"), F.col(f"_c_{text}")).otherwise(part))
    if "n_chars" in docs.columns:
        out = out.withColumn("_c_n_chars", F.length(f"_c_{text}").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"_c_{c}").alias(c) for c in docs.columns])
