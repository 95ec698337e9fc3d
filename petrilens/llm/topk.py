"""Exact top-k search by inner product with block-at-a-time pruning.

Candidates are laid out in document-range blocks, each with a forward index (its rows' integer terms) and the largest
and least value of every term.  A query's bound on a block is the sum over terms of the query's value times the one of
these two that gives more.  Before they are cut into blocks, rows are put in the order of the signs of their
``signs`` most varied terms, so that the rows of a block are near each other and its bounds tight.

Work is dealt by block of queries and a fixed number of lanes.  A lane takes its candidate blocks in the order of the
largest bound, scores a query through a block's forward index only while its bound reaches the query's k-th score so
far, and keeps one list of k per query, so what it returns does not grow with the blocks.  The lanes go in rounds of
twice as many blocks each; the k-th scores of a round's end hold for the next, and blocks that no query's bound reaches
are no longer read.  Ties of bound and k-th score are scored, so results are exact.

Rows: vectors that are null, or hold a null or non-finite component, take no part, as do null ids; repeated rows are
candidates each, but a query is asked once an id (its least vector), and no row of the query's own id answers it;
vectors of different lengths never meet; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from petrilens.llm.common import bounded_batches, cut, spread

_BLOCK = "block long, dim int, n int, ids binary, terms binary, top binary, low binary"
_FOUND = "q_block long, query_id long, vec_id long, score long"


def integer_vectors(vectors: DataFrame, *, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """vec_id, terms: floor(scale * x) of every component, of the vectors that take part."""
    v = F.col(vector_col).cast("array<double>")
    good = v.isNotNull() & F.col(id_col).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(good, F.transform(v, lambda x: F.floor(x * F.lit(float(scale))).cast("long"))).alias("terms")).filter("terms IS NOT NULL")


def by_signs(rows: DataFrame, signs: int) -> DataFrame:
    """``rows`` with place: the signs of the ``signs`` terms that vary most, the most varied first."""
    spread = rows.select(F.posexplode("terms").alias("i", "x")).groupBy("i").agg(F.var_pop("x").alias("v")).orderBy(F.desc("v"), "i").limit(signs)
    chosen = [r["i"] for r in spread.collect()]  # ``signs`` numbers
    sign = lambda i: F.coalesce((F.try_element_at("terms", F.lit(i + 1)) > 0).cast("long"), F.lit(0))
    place = F.lit(0).cast("long")
    for i in chosen:
        place = place * 2 + sign(i)
    return rows.withColumn("place", place)


def make_blocks(rows: DataFrame, block_rows: int) -> DataFrame:
    """Blocks of ``rows(vec_id, terms, place)``: at most ``block_rows`` rows of one length, in the order of place and id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, k, ids, terms = TaskContext.get().partitionId(), 0, [], []

        def close() -> pd.DataFrame:
            m = np.array(terms, np.int64).reshape(len(ids), -1)
            none = np.zeros(0, np.int64)
            top, low = (m.max(0), m.min(0)) if m.size else (none, none)
            return pd.DataFrame({"block": [(part << 32) + k], "dim": [m.shape[1]], "n": [len(ids)], "ids": [np.array(ids, np.int64).tobytes()], "terms": [m.tobytes()], "top": [top.tobytes()], "low": [low.tobytes()]})

        for b in batches:
            for i, t in zip(b["vec_id"], b["terms"], strict=True):
                if ids and (len(ids) == block_rows or len(t) != len(terms[0])):
                    yield close()
                    ids, terms, k = [], [], k + 1
                ids.append(i)
                terms.append(t)
        if ids:
            yield close()

    n = max(1, -(-rows.count() // (4 * block_rows)))
    keyed = rows.withColumn("size", F.size("terms"))
    # However many ranges the session makes of it, no more tasks cut blocks than the rows fill.
    dealt = keyed.repartitionByRange(n, "size", "place", "vec_id").coalesce(n)
    return dealt.sortWithinPartitions("size", "place", "vec_id").drop("size", "place").mapInPandas(run, _BLOCK)


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer a @ b.T: by floating point where every partial sum fits its 53 bits, else by integers."""
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _matrix(terms: bytes, n: int) -> np.ndarray:
    return np.frombuffer(terms, np.int64).reshape(n, -1)


def _bounds(q: np.ndarray, top: bytes, low: bytes) -> np.ndarray:
    return _exact(np.maximum(q, 0), np.frombuffer(top, np.int64)[None])[:, 0] + _exact(np.minimum(q, 0), np.frombuffer(low, np.int64)[None])[:, 0]


class _Best:
    """The k best (score, id) of each query of a block so far."""

    def __init__(self, ids: np.ndarray, k: int) -> None:
        self.ids, self.k = ids, k
        self.found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(ids)
        self.kth = np.full(len(ids), np.iinfo(np.int64).min)

    def add(self, at: int, score: np.ndarray, ids: np.ndarray) -> None:
        ok = np.flatnonzero((ids != self.ids[at]) & (score >= self.kth[at]))
        if len(ok) > self.k:
            least = np.partition(score[ok], len(ok) - self.k)[len(ok) - self.k]
            ok = ok[score[ok] >= least]
        s, i = np.concatenate([self.found[at][0], score[ok]]), np.concatenate([self.found[at][1], ids[ok]])
        keep = np.lexsort((i, -s))[: self.k]
        self.found[at] = s[keep], i[keep]
        if len(keep) == self.k:
            self.kth[at] = max(self.kth[at], s[keep[-1]])

    def rows(self, q_block: int) -> pd.DataFrame:
        n = [len(s) for s, _ in self.found]
        return pd.DataFrame({"q_block": q_block, "query_id": np.repeat(self.ids, n), "vec_id": np.concatenate([i for _, i in self.found]), "score": np.concatenate([s for s, _ in self.found])})


def _scored(jobs: DataFrame, k: int) -> DataFrame:
    """The k best of every query of a lane: ``jobs`` are runs (q_block, lane), the row of the queries first (with the
    k-th scores known), then the candidate blocks by their largest bound."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = q = block = None
        for b in batches:
            for r in b.itertuples(index=False):
                if r.kth is not None:
                    if best is not None:
                        yield best.rows(block)
                    ids = np.frombuffer(r.ids, np.int64)
                    best, q, block = _Best(ids, k), _matrix(r.terms, len(ids)), r.q_block
                    best.kth = np.frombuffer(r.kth, np.int64).copy()
                    continue
                use = np.flatnonzero(_bounds(q, r.top, r.low) >= best.kth)
                if len(use):
                    ids = np.frombuffer(r.ids, np.int64)
                    for at, row in zip(use, _exact(q[use], _matrix(r.terms, len(ids))), strict=True):
                        best.add(at, row, ids)
        if best is not None:
            yield best.rows(block)

    return jobs.mapInPandas(run, _FOUND)


def top_k(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, every: int = 20, scale: int = 64, block_rows: int = 512, query_rows: int = 4096, signs: int = 16, lanes: int = 8, first: int = 2, told: dict | None = None
) -> DataFrame:
    """Per query (id divisible by ``every``): query_id, rank, vec_id, score of its ``k`` highest scores over all rows of
    other ids, ties to the smaller id.  ``told``, if given, gets the number of (query block, block) pairs and of those
    that were never read."""
    bounded_batches(vectors.sparkSession)
    rows = cut(by_signs(cut(integer_vectors(vectors, id_col=id_col, vector_col=vector_col, scale=scale)), signs))
    blocks = cut(make_blocks(rows, block_rows))
    asked = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("terms", "place")).alias("r")).select("vec_id", "r.terms", "r.place")
    queries = cut(make_blocks(asked, query_rows)).select(F.col("block").alias("q_block"), "dim", "n", "ids", "terms")

    def summary(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"q_block": b["q_block"], "block": b["block"], "bounds": [_bounds(_matrix(r.q_terms, r.q_n), r.top, r.low).tobytes() for r in b.itertuples(index=False)]})

    # One row a pair of a block of queries and a block of rows, with a bound per query; dealt over the blocks of rows.
    parts = max(1, -(-blocks.count() // 64))
    left = queries.select("q_block", "dim", F.col("n").alias("q_n"), F.col("terms").alias("q_terms")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    right = blocks.select("block", "dim", "top", "low", F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int").alias("part"))
    pairs = spread(right, "dim", "part").join(left, ["dim", "part"]).select("q_block", "block", "q_terms", "q_n", "top", "low").mapInPandas(summary, "q_block long, block long, bounds binary")

    @F.pandas_udf("long")
    def largest(bounds: pd.Series) -> pd.Series:
        return pd.Series([int(np.frombuffer(x, np.int64).max(initial=np.iinfo(np.int64).min)) for x in bounds], dtype="int64")

    pairs = cut(pairs.withColumn("bound", largest("bounds")).withColumn("nth", F.row_number().over(Window.partitionBy("q_block").orderBy(F.desc("bound"), "block"))))
    size_of = pairs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("nth"), F.lit(0)).alias("last")).head()
    every_pair, last, read, best, done, size = size_of["n"], size_of["last"], 0, None, 0, first

    @F.pandas_udf("boolean")
    def reached(bounds: pd.Series, kth: pd.Series) -> pd.Series:
        return pd.Series([bool((np.frombuffer(x, np.int64) >= np.frombuffer(y, np.int64)).any()) for x, y in zip(bounds, kth, strict=True)])

    def known(best: DataFrame | None) -> DataFrame:
        """q_block, kth: the k-th scores so far, in the order of the block's queries."""

        def run(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            ids = np.frombuffer(a["ids"].iloc[0], np.int64)
            kth = b.groupby("query_id")["score"].agg(["min", "size"])
            kth = kth[kth["size"] >= k]["min"].reindex(ids)
            out = np.where(kth.isna(), np.iinfo(np.int64).min, kth.fillna(0)).astype(np.int64)
            return pd.DataFrame({"q_block": [a["q_block"].iloc[0]], "kth": [out.tobytes()]})

        if best is None:
            return queries.select("q_block", F.expr("cast(null as binary)").alias("kth"), "n").mapInPandas(lambda bs: (pd.DataFrame({"q_block": b["q_block"], "kth": [np.full(n, np.iinfo(np.int64).min).tobytes() for n in b["n"]]}) for b in bs), "q_block long, kth binary")
        return queries.select("q_block", "ids").groupBy("q_block").cogroup(best.groupBy("q_block")).applyInPandas(run, "q_block long, kth binary")

    top = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kth = cut(known(None))
    while done < last:
        chosen = pairs.filter((F.col("nth") > done) & (F.col("nth") <= done + size)).join(kth, "q_block").filter(reached("bounds", "kth"))
        chosen = cut(chosen.select("q_block", "block", "nth", F.pmod(F.col("nth"), F.lit(lanes)).alias("lane")))
        n = chosen.count()
        if n:
            read += n
            heads = chosen.select("q_block", "lane").distinct().join(queries, "q_block").join(kth, "q_block").select("q_block", "lane", F.lit(0).alias("nth"), "ids", "terms", F.expr("cast(null as binary)").alias("top"), F.expr("cast(null as binary)").alias("low"), "kth")
            bodies = chosen.join(blocks, "block").select("q_block", "lane", "nth", "ids", "terms", "top", "low", F.expr("cast(null as binary)").alias("kth"))
            jobs = spread(heads.unionByName(bodies), "q_block", "lane").sortWithinPartitions("q_block", "lane", "nth")
            found = _scored(jobs, k)
            found = found if best is None else best.unionByName(found)
            best = cut(found.withColumn("rank", F.row_number().over(top)).filter(F.col("rank") <= k).drop("rank"))
            kth = cut(known(best))
        done, size = done + size, size * 2
    if told is not None:
        told |= {"pairs": every_pair, "read": read}
    if best is None:
        best = vectors.sparkSession.createDataFrame([], _FOUND)
    return best.withColumn("rank", F.row_number().over(top).cast("int")).select("query_id", "rank", "vec_id", "score")
