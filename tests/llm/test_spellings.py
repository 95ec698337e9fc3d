"""Spelling variants against words compared one by one, and their edge cases."""

import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from petrilens.llm import queries, spellings

SMALL = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(docs, least_n=3):
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    n = {w: k for w, k in n.items() if k >= least_n and len(w) >= 5}
    by_size = {}
    for w in n:
        by_size.setdefault(len(w), []).append(w)
    form, near = {}, {}
    for w, k in n.items():
        close = [v for size in (len(w) - 1, len(w), len(w) + 1) for v in by_size.get(size, []) if one_edit(w, v)]
        best = min(close, key=lambda v: (-n[v], v), default=None)
        near[w], form[w] = len(close), best if best and n[best] >= 2 * k else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {w: (k, near[w], form[w], n.get(form[w]), root(w)) for w, k in n.items()}


def got(df):
    return {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in df.collect()}


def test_query_equals_one_by_one(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    want = expected(docs)
    assert got(queries.op12_spelling_variants(spark, SMALL)) == want
    assert sum(w[1] for w in want.values()) > 1000


def test_small_blocks_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(spellings, "BLOCK", 7)
    docs = [(i, " ".join(f"prefix{a}{b}ing" for a in "abcdefgh" for b in "ijklmnop")) for i in range(4)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert got(spellings.group_spellings(df)) == expected(docs)


words = st.text("abAé", min_size=5, max_size=9)


@settings(max_examples=60, deadline=None)
@given(st.lists(words, min_size=1, max_size=30, unique=True), st.lists(words, min_size=1, max_size=30, unique=True))
def test_tiles_find_every_edit_once(a, b):
    for longest in range(5, 10):
        for same in (False, True):
            left, right = ([w for w in side if longest - 1 <= len(w) <= longest] for side in (a, a if same else b))
            if not left or not right:
                continue
            for by_suffix in (False, True):
                i, j = spellings.near_tile(left, right, longest, by_suffix)
                half = longest // 2
                want = {(x, y) for x, v in enumerate(left) for y, w in enumerate(right) if max(len(v), len(w)) == longest and one_edit(v, w) and not (by_suffix and v[:half] == w[:half])}
                assert {*zip(i.tolist(), j.tolist(), strict=True)} == want
                assert len(i) == len(want)


def test_edges(spark):
    docs = [(1, None), (2, ""), (None, "Straße straße STRASSE größe"), (3, "GRÖßE größe größe grÖße"), (3, "GRÖßE größe größe grÖße"), (4, "hello " * 40000), (5, "hallo hello hullo " * 3), (6, "a b c \U0001f600 xx")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' as word", "1 as n", "2 as id", "3 as run", "4 as m")
    assert got(spellings.group_spellings(df)) == expected(docs)
    assert spellings.group_spellings(df.where("doc_id < 0")).count() == 0


@pytest.mark.parametrize("least_n", [1, 2])
def test_parameters(spark, least_n):
    docs = [(1, "colour color colours"), (2, "colour")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert got(spellings.group_spellings(df, least_n=least_n)) == expected(docs, least_n)
