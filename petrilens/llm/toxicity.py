"""Toxicity by a convolutional text classifier: hashed word embeddings, several filter widths, max pooling.

A word's embedding is the sum of the hashed rows of the word and of its first four and five letters, so that unseen
forms of a known stem are near it.

The network starts in numpy on the driver from bounded labelled rows (``per_class`` rows of each label at most, by the
order of a hash of the id; a row is its hashed words, made on the executors).  If there are more, tasks go on over all
labelled rows and whole texts, and the model is the mean of theirs.  Scoring runs over every whole text: a convolution over embeddings is a sum of table rows, one per filter tap, so a text costs a few gathers.

Batches take both labels, and the languages of each label, equally often, or rows weigh so, so that a rare language is
learned too.  A score depends on the text alone.  The score is shifted so that 0.5 splits the calibration part best (all of
it is scored on the executors and counted by logit); besides, a threshold per language is calibrated on it, for callers who know the language.

Rows: a null text counts as an empty one and gets the score of no word at all; rows of labels with a null id or label
are passed over; of several labels of a document the highest counts; without labels of both kinds every score is 0.
"""

from __future__ import annotations

import copy
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from petrilens.llm.common import bounded_batches, cut, handing_back, maybe_broadcast

_WORD = re.compile(r"[^\W_]+")
#: Rows of words that a task keeps at most before it starts afresh.
_MOST_KEPT = 60_000
_STEMS = (4, 5)
#: Words of a text that are read at once in training, and rows that a task learns from.
_PIECE, _ROWS = 1 << 15, 5_000
_cache: dict[tuple[int, str], tuple[int, ...]] = {}


def words_of(text: str | None) -> list[str]:
    """Lower-cased words of a whole text; a text without words has one empty word."""
    return _WORD.findall((text or "").lower()) or [""]


def word_features(word: str, buckets: int) -> tuple[int, ...]:
    """Hash buckets (from 1) of a word and its stems; 0 stands for no feature."""
    made = _cache.get((buckets, word))
    if made is None:
        if len(_cache) > _MOST_KEPT:
            _cache.clear()
        parts = [f"w|{word}" if word else "", *(f"{n}|{word[:n]}" if len(word) >= n else "" for n in _STEMS)]
        made = _cache[buckets, word] = tuple(zlib.crc32(x.encode("utf-8", "replace")) % (buckets - 1) + 1 if x else 0 for x in parts)
    return made


def text_features(text: str | None, buckets: int) -> np.ndarray:
    """Features of all words of a whole text, one row a word."""
    words = words_of(text)
    at = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return np.array([word_features(w, buckets) for w in at], np.int32)[np.fromiter(map(at.__getitem__, words), np.int64, len(words))]


@dataclass
class TextCNN:
    """Embedding table, filters per width, output weights; ``shift`` moves the logit of the score 0.5."""

    buckets: int = 1 << 17
    dim: int = 16
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 12
    seed: int = 7
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        r = np.random.default_rng(self.seed)
        self.p = {"E": r.normal(0, 0.3, (self.buckets, self.dim)), "o": r.normal(0, 0.3, self.filters * len(self.widths)), "c": np.zeros(1)}
        for w in self.widths:
            self.p[f"K{w}"] = r.normal(0, 1 / np.sqrt(w * self.dim), (w, self.dim, self.filters))
            self.p[f"b{w}"] = np.zeros(self.filters)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def embed(self, ids: np.ndarray) -> np.ndarray:
        return self.p["E"][ids].sum(1) * (ids[:, :1] > 0)

    def forward(self, docs: list[np.ndarray]) -> tuple[np.ndarray, tuple[np.ndarray, list]]:
        """Logits of a batch, its pooled values, and for each width the features of the winning windows.  Texts are read in
        pieces that overlap by the widest filter less one word, some pieces at once, so memory doesn't grow with a text."""
        pad = max(self.widths) - 1
        gap = np.zeros((pad, 1 + len(_STEMS)), np.int32)
        top = {w: np.full((len(docs), self.filters), -np.inf, np.float32) for w in self.widths}
        won = {w: np.zeros((len(docs), self.filters, w, 1 + len(_STEMS)), np.int32) for w in self.widths}
        pieces = [(k, a, min(a + _PIECE, len(d))) for k, d in enumerate(docs) for a in range(0, len(d), _PIECE)]
        while pieces:
            n = max(1, int(np.searchsorted(np.cumsum([b - a for _, a, b in pieces]), 2 * _PIECE, "right")))
            now, pieces = pieces[:n], pieces[n:]
            ids = np.concatenate([x for k, a, b in now for x in (docs[k][a : b + pad], gap[: max(0, b + pad - len(docs[k]))])])
            e, first = self.embed(ids), 0
            acts = {w: sum(e[j : len(ids) - w + 1 + j] @ self.p[f"K{w}"][j] for j in range(w)) for w in self.widths}
            for k, a, b in now:
                for w, act in acts.items():
                    best = first + act[first : first + b - a].argmax(0)
                    value = act[best, np.arange(self.filters)]
                    more = value > top[w][k]
                    top[w][k, more] = value[more]
                    won[w][k, more] = ids[best[more, None] + np.arange(w)]
                first += b - a + pad
        pooled = [top[w] + self.p[f"b{w}"] for w in self.widths]
        h = np.concatenate([np.maximum(x, 0) for x in pooled], 1)
        return h @ self.p["o"] + self.p["c"][0], (h, [(w, won[w], x > 0) for w, x in zip(self.widths, pooled, strict=True)])

    def gradient(self, docs: list[np.ndarray], y: np.ndarray, weight: np.ndarray, decay: float) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
        """Of the weighed logistic loss: by parameter, and the rows of the embedding table that are met and theirs.  Only the
        winning positions of the pooling get gradients."""
        logit, (h, kept) = self.forward(docs)
        d = ((1 / (1 + np.exp(-np.clip(logit, -60, 60)))) - y).astype(np.float32) * weight.astype(np.float32)
        g = {"o": h.T @ d + decay * self.p["o"], "c": np.array([d.sum()], np.float32)}
        gh, rows, parts = d[:, None] * self.p["o"][None], [], []
        for i, (w, won, on) in enumerate(kept):
            gk = gh[:, i * self.filters : (i + 1) * self.filters] * on
            g[f"b{w}"] = gk.sum(0)
            gw = np.zeros_like(self.p[f"K{w}"])
            for j in range(w):
                ids = won[:, :, j].reshape(-1, 1 + len(_STEMS))
                gw[j] = np.einsum("df,dfe->ef", gk, self.embed(ids).reshape(len(docs), self.filters, self.dim))
                hit = np.flatnonzero((gk.ravel() != 0) & (ids[:, 0] > 0))
                rows.append(ids[hit])
                parts.append((gk[:, :, None] * self.p[f"K{w}"][j].T[None]).reshape(-1, self.dim)[hit])
            g[f"K{w}"] = gw + decay * self.p[f"K{w}"]
        flat = np.concatenate(rows)
        order = np.argsort(flat, axis=None, kind="stable")
        used, first = np.unique(flat.ravel()[order], return_index=True)
        gr = np.add.reduceat(np.concatenate(parts)[order // flat.shape[1]], first, 0) if len(used) else np.zeros((0, self.dim), np.float32)
        gr[used == 0] = 0
        return g, used, gr + decay * self.p["E"][used]

    def steps(self, rate: float, decay: float) -> Callable[[list[np.ndarray], np.ndarray, np.ndarray], np.ndarray]:
        """A function that makes one step of Adam on the rows given (features, labels, weights) and tells the rows of the
        embedding table that it changed."""
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        t = 0

        def step(docs: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> np.ndarray:
            nonlocal t
            t += 1
            g, used, gr = self.gradient(docs, y, weight, decay)
            size = rate * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
            for k, x in g.items():
                m[k] = 0.9 * m[k] + 0.1 * x
                v2[k] = 0.999 * v2[k] + 0.001 * x * x
                self.p[k] = (self.p[k] - size * m[k] / (np.sqrt(v2[k]) + 1e-8)).astype(np.float32)
            m["E"][used] = 0.9 * m["E"][used] + 0.1 * gr
            v2["E"][used] = 0.999 * v2["E"][used] + 0.001 * gr * gr
            self.p["E"][used] -= size * m["E"][used] / (np.sqrt(v2["E"][used]) + 1e-8)
            return used

        return step

    def train(self, docs: list[np.ndarray], y: np.ndarray, group: np.ndarray, steps: int, batch: int, rate: float, decay: float) -> None:
        """Steps on the logistic loss of batches that take both labels, and the groups of a label, equally often."""
        r, step = np.random.default_rng(self.seed), self.steps(rate, decay)
        rows = {k: [np.flatnonzero((y == k) & (group == g)) for g in np.unique(group[y == k])] for k in (1, 0)}
        for _ in range(steps):
            pick = np.array([r.choice(rows[k][r.integers(len(rows[k]))]) for k in (1, 0) for _ in range(batch // 2)])
            step([docs[i] for i in pick], y[pick], np.full(len(pick), 1 / len(pick)))

    def shared(self) -> np.ndarray:
        """All parameters but the embedding table, in rows of ``dim`` numbers."""
        flat = np.concatenate([self.p[k].ravel() for k in sorted(self.p) if k != "E"])
        return np.pad(flat, (0, -len(flat) % self.dim)).reshape(-1, self.dim)

    def take_shared(self, rows: np.ndarray) -> None:
        flat, at = rows.ravel(), 0
        for k in sorted(self.p):
            if k != "E":
                n = self.p[k].size
                self.p[k], at = flat[at : at + n].reshape(self.p[k].shape).astype(np.float32), at + n

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    """Logits of texts by table rows, made per word when it is first met."""

    def __init__(self, model: TextCNN) -> None:
        self.model, p = model, model.p
        taps = max(model.widths)
        self.kernels = [np.concatenate([p[f"K{w}"][j] for w in model.widths if w > j], 1) for j in range(taps)]
        self.bias = np.concatenate([p[f"b{w}"] for w in model.widths])
        self.reset()

    def reset(self) -> None:
        self.rows: dict[str, int] = {}
        self.tables = [np.zeros((1 << 15, k.shape[1]), np.float32) for k in self.kernels]

    def _rows_of(self, words: list[str]) -> np.ndarray:
        if len(self.rows) > _MOST_KEPT:
            self.reset()
        rows = self.rows
        new = [w for w in dict.fromkeys(words) if w not in rows]
        if new:
            first = len(rows)
            rows.update(zip(new, range(first, first + len(new)), strict=True))
            x = self.model.embed(np.array([word_features(w, self.model.buckets) for w in new], np.int32))
            for i, k in enumerate(self.kernels):
                if len(rows) > len(self.tables[i]):
                    self.tables[i] = np.concatenate([self.tables[i], np.zeros((max(len(rows) // 2, len(rows) - len(self.tables[i])), k.shape[1]), np.float32)])
                self.tables[i][first : len(rows)] = x @ k
        return np.fromiter(map(rows.__getitem__, words), np.int64, len(words))

    def logit(self, text: str | None, chunk: int = 1 << 15) -> float:
        """Long texts are taken in pieces that overlap by the widest filter less one word, so memory stays bounded."""
        words, top = words_of(text), None
        for a in range(0, len(words), chunk):
            x = self._rows_of(words[a : a + chunk + len(self.kernels) - 1])
            n = min(chunk, len(words) - a)
            act = self.tables[0][x[:n]]
            for j in range(1, len(self.kernels)):
                m = min(n, len(x) - j)
                if m > 0:
                    act[:m, act.shape[1] - self.tables[j].shape[1] :] += self.tables[j][x[j : j + m]]
            top = act.max(0) if top is None else np.maximum(top, act.max(0))
        return float(np.maximum(top + self.bias, 0) @ self.model.p["o"] + self.model.p["c"][0])


def best_shift(z: np.ndarray, ones: np.ndarray, zeros: np.ndarray, prior: float) -> float:
    """The logit at which accuracy, both labels weighed by their share in all rows, is best (mid-way between rows);
    ``ones`` and ``zeros`` count the rows of either label at each of the ascending logits."""
    w1, w0 = ones * (prior / max(1, ones.sum())), zeros * ((1 - prior) / max(1, zeros.sum()))
    wrong = w0.sum() + np.concatenate([[0.0], np.cumsum(w1 - w0)])
    k = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    k = int(k[len(k) // 2])
    return float((z[max(0, k - 1)] + z[min(len(z) - 1, k)]) / 2)


def distinct_shingles(ids: np.ndarray, width: int) -> np.ndarray:
    """The words of a text without those that only repeat shingles of ``width`` words met before: max pooling sees no
    difference but for shingles that the cuts make."""
    if len(ids) <= width:
        return ids
    runs = np.concatenate([ids[j : len(ids) - width + 1 + j] for j in range(width)], 1)
    first = np.sort(np.unique(runs, axis=0, return_index=True)[1])
    return ids[np.unique(first[:, None] + np.arange(width))]


def start_rows(rows: DataFrame, per_class: int, buckets: int, most_words: int, width: int) -> pd.DataFrame:
    """At most ``per_class`` rows of each label of ``rows(doc_id, lang, text, y)`` that the network starts from: doc_id, lang,
    y, hashed words.  As they come to the driver, texts of more than ``most_words`` words (repeated shingles once) are
    no part of the start; like all rows they are learned after it."""
    key = F.md5(F.concat(F.lit("toxic|"), F.col("doc_id").cast("string")))
    chosen = None
    for y in (0, 1):
        part = rows.select("doc_id", "y").filter(F.col("y") == y).distinct().orderBy(key, "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids = [distinct_shingles(text_features(t, buckets), width) for t in b["text"]]
            made = pd.DataFrame({"doc_id": b["doc_id"], "lang": b["lang"], "y": b["y"], "ids": [x.tobytes() for x in ids]})
            yield made[[len(x) <= most_words for x in ids]]

    kind = rows.schema["doc_id"].dataType.simpleString()
    found = rows.join(F.broadcast(chosen.select("doc_id")), "doc_id").mapInPandas(handing_back(hashed), f"doc_id {kind}, lang string, y int, ids binary").toPandas()
    return found.sort_values(["doc_id", "ids"], kind="stable").drop_duplicates("doc_id").reset_index(drop=True)


def learn_all(model: TextCNN, rows: DataFrame, counts: dict[tuple[int, str], int], batch: int, rate: float, decay: float) -> None:
    """One pass over all ``rows(lang, y, text)``: every task goes on from the model with steps over its rows, and the model
    becomes the mean of the tasks'.  A row weighs by its label and language so that both labels, and the languages of
    each, count alike.  What a task tells is bounded by the model, and the mean of an embedding is of those that met it."""
    langs = {y: sum(1 for k, _ in counts if k == y) for y in (0, 1)}
    total = sum(counts.values())
    weights = {k: total / (2 * langs[k[0]] * n) for k, n in counts.items()}
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def learned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net = copy.deepcopy(shared.value)
        start, step, met, n = net.shared(), net.steps(rate, decay), np.zeros(net.buckets), 0
        held: list[tuple[np.ndarray, int, float]] = []

        def go() -> None:
            docs, y, weight = zip(*held, strict=True)
            met[step(list(docs), np.array(y), np.array(weight) / len(docs))] += 1
            held.clear()

        for b in batches:
            for lang, y, text in zip(b["lang"], b["y"], b["text"], strict=True):
                held.append((text_features(text, net.buckets), int(y), weights[int(y), lang]))
                n += 1
                if len(held) == batch:
                    go()
        if held:
            go()
        _cache.clear()
        at = np.flatnonzero(met)
        moved = np.concatenate([net.p["E"][at] - shared.value.p["E"][at], net.shared() - start]).astype(np.float32)
        yield pd.DataFrame({"i": np.concatenate([at, -1 - np.arange(len(start))]), "n": np.concatenate([met[at], np.full(len(start), float(n))]), "v": [x.tobytes() for x in moved]})

    def mean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        most, dim = shared.value.buckets + len(shared.value.shared()), shared.value.dim
        n, v = np.zeros(most), np.zeros((most, dim))
        for b in batches:
            np.add.at(n, b["i"].to_numpy(), b["n"].to_numpy())
            np.add.at(v, b["i"].to_numpy(), b["n"].to_numpy()[:, None] * np.frombuffer(b"".join(b["v"]), np.float32).reshape(-1, dim))
        at = np.flatnonzero(n)
        yield pd.DataFrame({"i": np.where(at < shared.value.buckets, at, at - most), "v": [x.tobytes() for x in (v[at] / n[at, None]).astype(np.float32)]})

    tasks = max(1, -(-total // _ROWS))
    told = rows.select(F.coalesce("lang", F.lit("")).alias("lang"), "y", "text").coalesce(tasks).mapInPandas(handing_back(learned), "i int, n double, v binary")
    got = told.repartition("i").mapInPandas(handing_back(mean), "i int, v binary").toPandas()
    i, v = got["i"].to_numpy(), np.frombuffer(b"".join(got["v"]), np.float32).reshape(-1, model.dim)
    model.p["E"][i[i >= 0]] += v[i >= 0]
    rest = model.shared()
    rest[-1 - i[i < 0]] += v[i < 0]
    model.take_shared(rest)


def logit_counts(model: TextCNN, rows: DataFrame) -> pd.DataFrame:
    """lang, z, ones, zeros: how many ``rows(lang, y, text)`` of either label have a logit, rounded to a 1000th."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net = shared.value.scorer()
        for b in batches:
            yield pd.DataFrame({"lang": b["lang"], "y": b["y"], "z": [round(1000 * min(60.0, max(-60.0, net.logit(t)))) for t in b["text"]]})
        del net
        _cache.clear()

    z = rows.select(F.coalesce("lang", F.lit("")).alias("lang"), "y", "text").mapInPandas(handing_back(scored), "lang string, y int, z int")
    told = z.groupBy("lang", "z").agg(F.sum("y").alias("ones"), F.sum(1 - F.col("y")).alias("zeros")).toPandas().sort_values(["lang", "z"])
    return told.assign(z=told["z"] / 1000)


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, *, use: Column | None = None, label: str = "toxic", per_class: int = 2000, steps: int = 900, batch: int = 64, rate: float = 4e-3, decay: float = 3e-4, least_rows: int = 5, most_words: int = 20_000, **shape
) -> TextCNN | None:
    """The trained and calibrated network, or None without labels of both kinds.

    The network starts from ``steps`` steps over at most ``per_class`` rows of each label, with texts of at most
    ``most_words`` words; unless these are all, it then learns from all labelled rows and whole texts (``learn_all``).
    A fifth of the labelled rows (by a hash of the id) is kept from training, and all of it calibrates the shift and the
    thresholds by language (a language with under ``least_rows`` such rows of either kind takes the common one, 0.5).
    """
    model = TextCNN(**shape)
    bounded_batches(docs.sparkSession)
    lab = labels.filter((F.lit(True) if use is None else use) & F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y")).filter("y in (0, 1)")
    lab = cut(lab)
    known = lab.groupBy("y").count().toPandas().set_index("y")["count"].to_dict()
    prior = known.get(1, 0) / max(1, sum(known.values()))
    lab = maybe_broadcast(lab, 2_000_000)
    held = F.crc32(F.concat(F.lit("calibrate|"), F.col("doc_id").cast("string"))) % 5 == 0
    sizes = docs.select("doc_id", "lang").join(lab, "doc_id").groupBy(held.alias("held"), "y", F.coalesce("lang", F.lit("")).alias("lang")).agg(F.count(F.lit(1)).alias("n")).toPandas()
    if sizes["y"].nunique() < 2:
        return None
    rows = docs.select("doc_id", "lang", "text").join(lab, "doc_id")
    test = rows
    by = sizes[sizes["held"]].groupby("y")["n"].sum()
    if len(by) == 2 and by.min() >= 5 and sizes.loc[~sizes["held"], "y"].nunique() == 2:
        rows, test, sizes = rows.filter(~held), rows.filter(held), sizes[~sizes["held"]]
    start = start_rows(rows, per_class, model.buckets, most_words, max(model.widths))
    counts = sizes.groupby(["y", "lang"])["n"].sum().to_dict()
    y = start["y"].to_numpy()
    if len(np.unique(y)) == 2:
        model.train([np.frombuffer(b, np.int32).reshape(-1, 1 + len(_STEMS)) for b in start["ids"]], y, start["lang"].fillna("").to_numpy(), steps, batch, rate, decay)
    if len(start) < sum(counts.values()):
        learn_all(model, rows, counts, batch // 2, rate / 2, decay)
    told = logit_counts(model, test)
    all_ = told.groupby("z")[["ones", "zeros"]].sum()
    model.shift = best_shift(all_.index.to_numpy(), all_["ones"].to_numpy(), all_["zeros"].to_numpy(), prior)
    for lang, here in told.groupby("lang"):
        if min(here["ones"].sum(), here["zeros"].sum()) >= least_rows:
            model.thresholds[lang] = float(1 / (1 + np.exp(model.shift - best_shift(*(here[c].to_numpy() for c in ("z", "ones", "zeros")), prior))))
    return model


def score_toxicity(docs: DataFrame, model: TextCNN | None) -> DataFrame:
    """``docs`` with two more columns: ``score`` (0 to 1) and ``threshold``, the one calibrated for the row's language
    (0.5 where none is).  Columns of ``docs`` of these names are replaced."""
    docs = docs.drop("score", "threshold")
    bounded_batches(docs.sparkSession)
    if model is None:
        return docs.withColumn("score", F.lit(0.0)).withColumn("threshold", F.lit(0.5))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        net = shared.value.scorer()
        for b in batches:
            z = np.array([net.logit(t) for t in b], np.float64) - net.model.shift
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -60, 60))))
        del net
        _cache.clear()  # the worker goes on to other work

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from handing_back(scored)(batches)

    limit = F.lit(0.5)
    for lang, t in sorted(model.thresholds.items()):
        limit = F.when(F.col("lang") == lang, F.lit(t)).otherwise(limit)
    return docs.withColumn("score", score("text")).withColumn("threshold", limit)
