"""Near duplicates by SimHash fingerprints and multi-index hashing.

A 64-bit fingerprint has two segments of 32 bits, each with a table of the fingerprints by the segment's value.  Two
fingerprints at 2 or fewer differing bits differ in at most one bit of the first segment or in none of the second, so
looking up the Hamming ball of radius 1 around the first segment and the second segment's own value meets every such
pair.  Matches are verified by their complete distance.

Equal fingerprints are one row before any of this.  A table entry with over ``_MOST`` fingerprints (a family that
differs in one segment only) is split by the ball of radius 1 in the other segment: two fingerprints of the entry at 2
or fewer bits share a member of it, and no such entry ever holds more than 33 fingerprints, whatever the data.

Rows: a null text counts as an empty one; texts without words have fingerprint zero and link like any other; a null id
is never the least one (a component of null ids has none); repeated rows of one id give one row each; empty tables
give no rows; other columns never matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from petrilens.llm.common import bounded_batches, cut, handing_back, maybe_broadcast, packed, spread
from petrilens.operators.graph import connected_components

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_CHUNK = 1 << 16
#: Fingerprints under one value of a segment beyond which the entry is split by the other segment.
_MOST = 64


def _majority(h: np.ndarray) -> int:
    """The 64 bits that are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for a in range(0, len(h), _CHUNK):
        part = np.ascontiguousarray(h[a : a + _CHUNK])
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.dtype("<u8"))[0])


def fingerprint(text: str | None, words_in: int = 3) -> int:
    """The unsigned 64-bit SimHash of a whole text's word shingles, repeats included."""
    words = _WORD.findall((text or "").translate(_UPPER))
    if not words:
        return 0
    n, one = max(1, len(words) - words_in + 1), xxhash.xxh64_intdigest
    return _majority(np.array([one(" ".join(words[i : i + words_in]), 42) for i in range(n)], np.dtype("<u8")))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words_in: int = 3) -> DataFrame:
    """Per row: doc_id, fp (the fingerprint's 64 bits as a long)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "fp": np.array([fingerprint(t, words_in) for t in b["text"]], np.uint64).view(np.int64)})

    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(handing_back(run), f"doc_id {kind}, fp long")


def _ball(value: Column) -> Column:
    """The 33 values at most one bit from a 32-bit value."""
    return F.transform(F.array(F.lit(0).cast("long"), *[F.lit(1 << i).cast("long") for i in range(32)]), lambda m: value.bitwiseXOR(m))


def links(distinct: DataFrame, name: str = "fp") -> DataFrame:
    """Links (a, b) between all fingerprints of ``distinct(fp)`` at 2 or fewer differing bits, as fingerprints or as
    what the long column ``name`` calls them; the lesser fingerprint of a link is ``a``'s."""
    fps = spread(distinct.select("fp", F.col(name).alias("name")), "fp")
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned("fp", 32)
    entry = lambda segment, value: F.struct(F.lit(segment).cast("tinyint").alias("segment"), value.alias("value"))
    table = fps.select("fp", "name", F.explode(F.array(entry(0, low), entry(1, high))).alias("e")).select("fp", "name", "e.segment", "e.value")
    asked = F.concat(F.transform(_ball(low), lambda v: entry(0, v)), F.array(entry(1, high)))
    probes = fps.select("fp", "name", F.explode(asked).alias("e")).select(F.col("fp").alias("q"), F.col("name").alias("q_name"), "e.segment", "e.value")
    hot, n_hot = packed(table.groupBy("segment", "value").count().filter(F.col("count") > _MOST).select("segment", "value"))
    distance = F.bit_count(F.col("fp").bitwiseXOR(F.col("q")))

    def matched(t: DataFrame, p: DataFrame, key: list[str]) -> DataFrame:
        # Spark sizes an exploded table as if it had one row a row: without the hint it broadcasts all balls.
        met = t.join(p.hint("merge"), key).filter((F.col("fp") != F.col("q")) & (distance <= 2))
        first = F.col("fp") < F.col("q")
        return met.select(F.when(first, F.col("name")).otherwise(F.col("q_name")).alias("a"), F.when(first, F.col("q_name")).otherwise(F.col("name")).alias("b"))

    key = ["segment", "value"]
    if not n_hot:
        return matched(table, probes, key).distinct()
    hot = F.broadcast(hot) if n_hot <= 50_000 else hot
    other = lambda c: F.when(F.col("segment") == 0, F.shiftrightunsigned(c, 32)).otherwise(F.col(c).bitwiseAND(F.lit(0xFFFFFFFF)))
    finer = lambda d, c: d.join(hot, key, "left_semi").withColumn("near", F.explode(_ball(other(c))))
    cold = matched(table.join(hot, key, "left_anti"), probes.join(hot, key, "left_anti"), key)
    return cold.union(matched(finer(table, "fp"), finer(probes, "q"), [*key, "near"])).distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words_in: int = 3) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id (the least doc_id of its component)."""
    fps = cut(fingerprints(docs, id_col=id_col, text_col=text_col, words_in=words_in))
    least = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    root = connected_components(links(least)).select(F.col("node").alias("fp"), F.col("component").alias("root"))
    classes = cut(least.join(root, "fp").select("fp", "root", "least"))
    best = classes.groupBy("root").agg(F.min("least").alias("component"))
    linked = classes.join(best, "root").select("fp", "component")
    names = least.join(linked, "fp", "left").select(F.col("fp").alias("_fp"), F.coalesce("component", "least").alias("component_id"))
    out = fps.join(names, F.col("fp") == F.col("_fp"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# One document of each group.  Texts at a shingle similarity of 0.8 differ in 5 to 16 of 64 fingerprint bits, far beyond
# the radius for which balls in segments stay small; so besides the fingerprint links, candidates come from bands of
# minima, and are verified by the exact similarity of their whole shingle sets.

_word_hash: dict[str, int] = {}


def shingle_hashes(text: str | None, words_in: int = 5) -> np.ndarray:
    """64-bit hashes of a whole text's word shingles in order (fewer words: the whole sequence; none: empty)."""
    words = _WORD.findall((text or "").translate(_UPPER))
    if not words:
        return np.zeros(0, np.uint64)
    if len(_word_hash) > 50_000:
        _word_hash.clear()
    known, one = _word_hash, xxhash.xxh64_intdigest
    for w in set(words).difference(known):
        known[w] = one(w)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    k = min(words_in, len(h))
    out = np.zeros(len(h) - k + 1, np.uint64)
    for j in range(k):
        out = (out ^ h[j : j + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def shingle_set(text: str | None, words_in: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a whole text's word shingles."""
    return np.unique(shingle_hashes(text, words_in))


def _set_name(s: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(s.tobytes())).astype(np.int64))


def _bands(s: np.ndarray, odd: np.ndarray, bands: int) -> np.ndarray:
    """One hash per band of minima."""
    low = np.full(len(odd), np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(s), 1024):
        low = np.minimum(low, (s[a : a + 1024, None] * odd).min(0))
    out = np.zeros(bands, np.uint64)
    for j in range(len(odd) // bands):
        out = (out ^ low[j * bands : (j + 1) * bands]) * np.uint64(0xC2B2AE3D27D4EB4F)
        out ^= out >> np.uint64(31)
    return out


def signatures(docs: DataFrame, *, id_col: str, text_col: str, words_in: int, bands: int, rows: int) -> DataFrame:
    """Per row, from one pass over the texts: id, fp, same (names the shingle set), n (its size), bands."""
    odd = np.random.default_rng(11).integers(1, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = []
            for t in b["text"]:
                h = shingle_hashes(t, words_in)
                s = np.unique(h)
                fp = np.uint64(_majority(h) if len(h) else 0).astype(np.int64)
                made.append((int(fp), _set_name(s), len(s), _bands(s, odd, bands).view(np.int64)))
            yield pd.DataFrame({"id": b["id"], **dict(zip(("fp", "same", "n", "bands"), zip(*made, strict=True), strict=True))} if made else {c: [] for c in ("id", "fp", "same", "n", "bands")})
        _word_hash.clear()

    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(handing_back(run), f"id {kind}, fp long, same long, n long, bands array<long>")


def similar_groups(texts: DataFrame, made: DataFrame, known: DataFrame, *, words_in: int, similarity: float) -> DataFrame:
    """(same, root): shingle sets (by their names) that are linked to another, with the least name they reach.  Links are
    those of ``known(a, b)`` and of sets with a Jaccard similarity of at least ``similarity`` which share a band.
    ``made`` has the signatures of ``texts(id, text)``.

    A set is compared with the first and the last set of every bucket it is in.  That leaves pairs of buckets of four
    or more open; unless these links already join all of such a bucket, its sets go through ``open_pairs``, which
    misses no similar pair.
    """
    classes = made.groupBy("same", "n", "bands").agg(F.min("id").alias("rep"))
    held = classes.select("same", "n", F.posexplode("bands").alias("band", "key"))
    one = F.struct("same", "n")
    ends = held.groupBy("band", "key").agg(F.min(one).alias("lo"), F.max(one).alias("hi"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    near, _ = packed(held.join(ends, ["band", "key"]))
    sides = [near.select(F.col(f"{e}.same").alias("a"), F.col(f"{e}.n").alias("n_a"), F.col("same").alias("b"), F.col("n").alias("n_b")) for e in ("lo", "hi")]
    # Sizes bound the similarity from above.
    pairs = sides[0].union(sides[1]).filter("a <> b").filter(F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b") - 1e-9)
    pairs, _ = packed(pairs.select("a", "b", "n_b").distinct())
    crowds = near.filter("size > 3").select("same", "band", "key")
    asked = pairs.select(F.col("a").alias("same")).union(pairs.select("b")).union(crowds.select("same"))
    reps, n_reps = packed(classes.join(asked, "same", "left_semi").select("rep"), 1_000_000)
    reps = F.broadcast(reps) if n_reps <= 1_000_000 else reps

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [shingle_set(t, words_in) for t in b["text"]]
            yield pd.DataFrame({"same": [_set_name(s) for s in found], "shingles": [s.tobytes() for s in found]})
        _word_hash.clear()

    whole = texts.join(reps, F.col("id") == F.col("rep"), "left_semi").mapInPandas(handing_back(sets), "same long, shingles binary")
    whole = cut(whole.groupBy("same").agg(F.first("shingles").alias("shingles")))
    similar, _ = packed(verified(pairs, whole, similarity))
    root, _ = packed(connected_components(known.union(similar)).select(F.col("node").alias("same"), F.col("component").alias("root")))
    crowd = crowds.join(root, "same", "left").withColumn("root", F.coalesce("root", "same"))
    split = crowd.groupBy("band", "key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 < r1")
    rest, n_rest = packed(crowd.join(split.select("band", "key"), ["band", "key"], "left_semi").select("same", "root").distinct())
    if not n_rest:
        return root
    sizes = rest.join(classes.select("same", F.col("n").alias("n_b")), "same").select(F.col("same").alias("b"), "n_b")
    open_ones, n_open = packed(open_pairs(whole.join(rest, "same").select(F.col("same").alias("id"), "root", "shingles"), similarity).join(sizes, "b").select("a", "b", "n_b"))
    if not n_open:
        return root
    more, n_more = packed(verified(open_ones, whole, similarity))
    if not n_more:
        return root
    # The new links tie whole groups: only these are joined again.
    for side in ("a", "b"):
        more = more.join(root.select(F.col("same").alias(side), F.col("root").alias(f"r_{side}")), side, "left").withColumn(f"r_{side}", F.coalesce(f"r_{side}", side))
    top, _ = packed(connected_components(more.select(F.col("r_a").alias("a"), F.col("r_b").alias("b")).filter("a <> b")).toDF("node", "component"))
    moved = root.join(top, F.col("root") == F.col("node"), "left").select("same", F.coalesce("component", "root").alias("root"))
    single = top.join(root.select("same"), F.col("node") == F.col("same"), "left_anti").select(F.col("node").alias("same"), F.col("component").alias("root"))
    return packed(moved.union(single))[0]


def verified(pairs: DataFrame, whole: DataFrame, similarity: float, most: int = 1 << 20) -> DataFrame:
    """The links (a, b), a < b (some of them twice), of ``pairs(a, b, n_b)`` whose sets in ``whole(same, shingles)`` are similar enough.

    The partners of a set are dealt to parts of about ``most`` shingles, so a set with many partners is no hot key.  A
    part is a run of sorted rows, the set itself first and its partners after it; a task keeps one set and one batch.
    """
    load, n_load = packed(pairs.groupBy("a").agg((F.ceil(F.sum("n_b") / most)).cast("long").alias("parts")).filter("parts > 1"))
    dealt = pairs.join(F.broadcast(load) if n_load <= 50_000 else load, "a", "left") if n_load else pairs.withColumn("parts", F.lit(None).cast("long"))
    dealt = dealt.select("a", "b", F.coalesce(F.pmod(F.xxhash64("b"), F.col("parts")), F.lit(0)).alias("part"))
    firsts = dealt.select("a", "part").distinct().join(whole, F.col("a") == F.col("same")).select("a", "part", F.lit(None).cast("long").alias("b"), "shingles")
    rows = firsts.unionByName(dealt.join(whole, F.col("b") == F.col("same")).select("a", "part", "b", "shingles"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine = np.zeros(0, np.uint64)
        for batch in batches:
            out = []
            for a, b, blob in zip(batch["a"], batch["b"], batch["shingles"], strict=True):
                s = np.frombuffer(blob, np.uint64)
                if b is None or b != b:
                    mine = s.copy()
                    continue
                at = np.searchsorted(mine, s)
                both = int((mine[np.minimum(at, len(mine) - 1)] == s).sum()) if len(mine) else 0
                if both >= similarity * max(1, len(mine) + len(s) - both):
                    out.append((min(a, int(b)), max(a, int(b))))
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    # Text keeps all 64 bits of a name beside a null.
    keyed = rows.select("a", "part", F.col("b").cast("string").alias("b"), "shingles")
    return spread(keyed, "a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first()).mapInPandas(handing_back(run), "a long, b long")


def drop_near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words_in: int = 5, similarity: float = 0.8, bands: int = 24, rows: int = 5
) -> DataFrame:
    """``docs`` with one document of each group, the one with the least id (one row of it, with the least text, if it
    is repeated); rows with a null id stay.  Groups are the components of the fingerprint links, of the links of
    similar texts and of the rows that repeat an id."""
    named = docs.filter(F.col(id_col).isNotNull())
    made, _ = packed(signatures(named, id_col=id_col, text_col=text_col, words_in=words_in, bands=bands, rows=rows), 20_000)
    texts = named.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    of_fp, _ = packed(made.groupBy("fp").agg(F.min("same").alias("first"), F.max("same").alias("last")))
    known = links(of_fp, "first")
    several, n_several = packed(of_fp.filter("first < last").select("fp", "first"))
    if n_several:  # sets with one fingerprint
        several = F.broadcast(several) if n_several <= 50_000 else several
        known = known.union(made.join(several, "fp").select("first", "same").distinct())
    often, n_often = packed(made.groupBy("id").agg(F.min("same").alias("x"), F.max("same").alias("y"), F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("id", "x", "y"))
    often = F.broadcast(often) if n_often <= 1_000_000 else often
    if n_often:  # sets of one id
        known = known.union(made.join(often.filter("x < y"), "id").select("x", "same"))
    root = similar_groups(texts, made, known.toDF("a", "b").filter("a <> b"), words_in=words_in, similarity=similarity)
    whose, _ = packed(made.select("id", "same").join(root, "same", "left").select("id", F.coalesce("root", "same").alias("root")))
    least = whose.groupBy("root").agg(F.min("id").alias("least"))
    gone, n_gone = packed(whose.join(least, "root").filter("id <> least").select(F.col("id").alias("_gone")), 1_000_000)
    kept = docs.join(F.broadcast(gone) if n_gone <= 1_000_000 else gone, F.col(id_col) == F.col("_gone"), "left_anti")
    if not n_often:
        return kept
    often = often.select(F.col("id").alias("_often"))
    w = Window.partitionBy(id_col).orderBy(text_col)
    one_each = kept.join(often, F.col(id_col) == F.col("_often"), "left_semi").withColumn("_nth", F.row_number().over(w)).filter("_nth = 1").drop("_nth")
    return kept.join(often, F.col(id_col) == F.col("_often"), "left_anti").unionByName(one_each)


def open_pairs(sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b), a < b, of ``sets(id, root, shingles)`` with different roots, among them all at ``similarity`` or more.

    Two sets that share ``least`` shingles share one of the first ``size - least + 1`` of each in any common order of
    the shingles.  The order is by the number of sets that hold a shingle, rare ones first: what a crowd has in common
    comes last, so texts on one template do not meet by the template.  Under a shingle only sets outside the root that
    is most frequent there look for partners, so a large joined family costs no pairs of its own.
    """

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "root": b["root"], "shingles": [np.frombuffer(x, np.int64) for x in b["shingles"]]})

    lists = sets.select("id", "root", "shingles").mapInPandas(handing_back(listed), "id long, root long, shingles array<long>")
    held = cut(lists.select("id", "root", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle")))
    common = held.groupBy("shingle").agg(F.count(F.lit(1)).alias("df"))
    ranked = held.join(common, "shingle").withColumn("pos", F.row_number().over(Window.partitionBy("id").orderBy("df", "shingle")))
    first = cut(ranked.filter(F.col("pos") <= F.col("n") - F.ceil(similarity * F.col("n") - 1e-9) + 1).filter("df > 1").select("id", "root", "n", "shingle", "pos"))
    by_root = first.groupBy("shingle", "root").agg(F.count(F.lit(1)).alias("c"))
    mixed = by_root.groupBy("shingle").agg(F.max_by("root", "c").alias("big"), F.count(F.lit(1)).alias("roots")).filter("roots > 1").select("shingle", "big")
    x = first.join(mixed, "shingle").filter("root <> big").select("shingle", *[F.col(c).alias(f"x_{c}") for c in ("id", "root", "n", "pos")])
    y = first.join(mixed, "shingle").select("shingle", "big", *[F.col(c).alias(f"y_{c}") for c in ("id", "root", "n", "pos")])
    least = F.ceil(similarity / (1 + similarity) * (F.col("x_n") + F.col("y_n")) - 1e-9)
    met = x.join(y, "shingle").filter("x_root <> y_root AND (y_root = big OR x_id < y_id)")
    met = met.filter((F.col("x_pos") <= F.col("x_n") - least + 1) & (F.col("y_pos") <= F.col("y_n") - least + 1) & (F.least("x_n", "y_n") >= least))
    return met.select(F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b")).distinct()
