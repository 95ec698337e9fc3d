"""Grouping of spelling variants: words one inserted, deleted or replaced code point apart, by dense tiles.

If two words differ by one edit, their common prefix and common suffix together are at least the longer length m less
one, so one of them has m // 2 code points or more.  A word therefore stands in the groups of its first and its last
m // 2 code points, for m its own length and the next; any pair of near words meets in the group of the shared prefix,
or, without one, in that of the shared suffix.  A group is dealt by a hash of the word to blocks of about ``BLOCK``
words, padded code-point matrices, and pairs of blocks are compared densely: prefix and suffix lengths of all pairs at
once.  A tile returns one row a word (its number of near words and the best of them), never pairs.

Scale: occurrences are counted with map-side aggregation; only words that occur ``least_n`` times reach the groups.  A
group of g words costs g * g / 2 comparisons of bytes, in (g / BLOCK) ** 2 / 2 tiles that are dealt to tasks one by one,
so that a group that holds a third of the vocabulary is shared by all of them.

Rows: null and empty texts have no words; a null id counts as an empty one where the damage is drawn; repeated rows
count again; ties go to the smaller word in code-point order; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from petrilens.llm.common import cut, handing_back, spread
from petrilens.operators.graph import chain_heads

#: A word: a maximal run of Latin letters of the first 256 code points.
LETTERS = r"[A-Za-zÀ-ÿ]+"
#: Words of a block.
BLOCK = 512
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def count_words(docs: DataFrame, *, least_length: int = 5, least_n: int = 3, damage: int | None = 97, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: runs of letters in lower case (A-Z only) of at least ``least_length`` code points that occur at least
    ``least_n`` times.  Where ``damage`` divides h, the crc32 of ``id:run``, the run loses its code point h % length."""
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.translate(text_col, _UPPER, _LOWER), F.lit(LETTERS), F.lit(0))).alias("run"))
    runs = runs.where(F.length("run") >= least_length)
    word = F.col("run")
    if damage:
        h, size = F.crc32(F.concat("id", F.lit(":"), "run")), F.length("run")
        at = (h % size).cast("int")
        word = F.when(h % damage == 0, F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, size))).otherwise(word)
    return runs.select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") >= least_n) & (F.length("word") >= least_length))


def _matrix(words: list[str], width: int, right: bool) -> np.ndarray:
    """A row of code points a word, padded with zeros behind it or, for ``right``, before it."""
    fill = (lambda w: w.rjust(width, "\0")) if right else (lambda w: w.ljust(width, "\0"))
    return np.frombuffer("".join(map(fill, words)).encode("latin-1"), np.uint8).reshape(len(words), width)


def _common(a: np.ndarray, b: np.ndarray, columns: Iterator[int]) -> np.ndarray:
    """Lengths of the runs of equal code points of all pairs, over the columns in their order; padding equals nothing."""
    same, total = np.ones((len(a), len(b)), bool), np.zeros((len(a), len(b)), np.uint8)
    for j in columns:
        same &= (a[:, j, None] == b[None, :, j]) & (a[:, j, None] > 0)
        if not same.any():
            break
        total += same
    return total


def near_tile(a: list[str], b: list[str], longest: int, by_suffix: bool) -> tuple[np.ndarray, np.ndarray]:
    """Indices into ``a`` and ``b`` of the near pairs whose longer word has ``longest`` code points.  For groups of a
    suffix, pairs that share the prefix of a group are left to that group."""
    size_a, size_b = np.array([*map(len, a)]), np.array([*map(len, b)])
    prefix = _common(_matrix(a, longest, False), _matrix(b, longest, False), range(longest)).astype(np.int32)
    suffix = _common(_matrix(a, longest, True), _matrix(b, longest, True), range(longest - 1, -1, -1))
    most = np.maximum(size_a[:, None], size_b[None, :])
    near = (prefix + suffix >= longest - 1) & (most == longest) & ((prefix < longest) | (size_a[:, None] != size_b[None, :]))
    if by_suffix:
        near &= prefix < longest // 2
    return np.nonzero(near)


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, form_n, form: for the words (word, n) that have near words their number, and the near word of the
    largest n, ties to the smallest word."""
    size = F.length("word")
    sides = [F.struct((size + more).alias("m"), F.lit(side).alias("side"), key.alias("key")) for more in (0, 1) for side, key in (("p", F.substring(F.col("word"), F.lit(1), F.floor((size + more) / 2).cast("int"))), ("s", F.substring(F.col("word"), -F.floor((size + more) / 2).cast("int"), size)))]
    keyed = words.select("word", "n", F.inline(F.array(*sides)))
    group = ["m", "side", "key"]
    sizes = keyed.groupBy(*group).agg(F.count(F.lit(1)).alias("k"), F.max(F.length("word")).alias("most")).where("k > 1 and most = m")
    sizes = sizes.select(*group, F.ceil(F.col("k") / BLOCK).cast("int").alias("blocks"))
    keyed = keyed.join(sizes, group).withColumn("a", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    block = keyed.groupBy(*group, "blocks", "a").agg(F.sort_array(F.collect_list(F.struct("word", "n"))).alias("wa"))
    block = cut(block.select(*group, "blocks", "a", F.col("wa")["word"].alias("wa"), F.col("wa")["n"].alias("na")))
    own = block.select("m", "side", "wa", "na", F.lit(None).cast("array<string>").alias("wb"), F.lit(None).cast("array<long>").alias("nb"))
    other = block.where("blocks > 1").select(*group, F.col("a").alias("b"), F.col("wa").alias("wb"), F.col("na").alias("nb"))
    pairs = block.where("blocks > 1").withColumn("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("a < b")
    tiles = own.union(pairs.join(other, [*group, "b"]).select(*own.columns))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for m, side, wa, na, wb, nb in batch.itertuples(index=False):
                inside = wb is None
                wa, na = list(wa), np.asarray(na)
                wb, nb = (wa, na) if inside else (list(wb), np.asarray(nb))
                i, j = near_tile(wa, wb, m, side == "s")
                if len(i):
                    left, right = np.array(wa, object), np.array(wb, object)
                    found.append(pd.DataFrame({"word": left[i], "form": right[j], "form_n": nb[j]}))
                    if not inside:
                        found.append(pd.DataFrame({"word": right[j], "form": left[i], "form_n": na[i]}))
            if found:
                every = pd.concat(found).sort_values(["word", "form_n", "form"], ascending=[True, False, True])
                every["n_near"] = every.groupby("word")["form"].transform("size")
                yield every.drop_duplicates("word")[["word", "n_near", "form_n", "form"]]

    found = spread(tiles).mapInPandas(handing_back(run), "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("best.less")).alias("form_n"), F.col("best.form").alias("form"))


def group_spellings(docs: DataFrame, *, ratio: int = 2, **params) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word of ``count_words``: its form is the near word of the largest n
    if that is at least ``ratio`` times its own, its root the word that forms lead to."""
    words = cut(count_words(docs, **params))
    found = words.join(near_words(words), "word", "left")
    formed = F.col("form_n") >= ratio * F.col("n")
    found = cut(found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("form")).alias("form"), F.when(formed, F.col("form_n")).alias("form_n")))
    heads = chain_heads(found.where("form is not null"), "word", "form").select(F.col("node").alias("word"), F.col("head"))
    return found.join(heads, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("head", "word").alias("root"))
