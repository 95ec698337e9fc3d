"""Personal data by fixed patterns and a semi-Markov conditional random field.

The base spans (email, ip, card, phone) follow fixed patterns and always stay.  The field adds spans of other forms in
the text between them, such as obfuscated emails, phones without a plus, and secrets that are assigned to a name.  It
scores whole segments of a region's tokens, up to ``MOST_TOKENS`` long (a run of characters of a secret is one token,
however long), by features of the whole span and its surroundings; a dynamic program over the tokens chooses
boundaries and kinds together, every kind being open to every segment; a segment that it reads as of a base kind, whose
pattern has not found it, is no span.  Ties go to the kind listed first and to the
reading with fewer spans.  Weights are trained by gradient ascent on the log-likelihood (exact expectations from the
forward and backward sums) over regions of a bounded sample of rows, with the base spans as truth and with rewritten
copies of them as truth for the added kinds.  Work is linear in the length of a text.

Rows: null and empty texts have no span; spans count code points of the whole text, end exclusive; repeated rows give
one row each; an empty table gives no rows; other columns never matter.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from petrilens.llm.common import bounded_batches

Span = tuple[str, int, int]

BASE = ("email", "ip", "card", "phone")
ADDED = ("obfuscated_email", "national_phone", "secret")
KINDS = (*BASE, *ADDED)
MOST_TOKENS = 26

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        d = d * 2 if k % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, leftmost and non-overlapping per kind, by kind and start."""
    out: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:
        s = at
        while s > done and text[s - 1] in _LOCAL:
            s -= 1
        m = _DOMAIN.match(text, at) if s < at else None
        if m:
            out.append(("email", s, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return out


_NAMED = r"(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key)"
_REGION = re.compile(rf"[0-9][0-9 ().\-]{{7,}}[0-9]|{_NAMED} ?[=:] ?[\"']?[A-Za-z0-9+/_\-]{{8,}}|[\[({{<] ?at ?[\])}}>]|@|\b(?:at|dot)\b(?= [a-z0-9-]+ (?:dot|at)\b)|\bdot\b", re.I)
#: Long runs of characters that secrets are made of are one token.
_TOKEN = re.compile(r"[A-Za-z0-9+/_\-]{24,}|[A-Za-z0-9]+|[^\sA-Za-z0-9]|\s+")
_AROUND = 48


def regions(text: str) -> list[tuple[int, int]]:
    """Stretches that could hold a span: matches of a wide pattern with what stands around them, overlapping ones joined.
    No stretch crosses a line end but inside a match."""
    out: list[tuple[int, int]] = []
    for m in _REGION.finditer(text):
        a, b = m.span()
        a = max(a - _AROUND, text.rfind("\n", max(0, a - _AROUND), a) + 1, 0)
        end = text.find("\n", b, b + _AROUND)
        b = end if end >= 0 else min(b + _AROUND, len(text))
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def segment_features(text: str, a: int, b: int) -> list[str]:
    """Features of a whole span and of what stands around it."""
    s = text[a:b]
    digits = sum(c.isdigit() for c in s)
    letters = sum(c.isalpha() for c in s)
    before, after = text[max(0, a - 1) : a], text[b : b + 1]
    shape = re.sub(r"[A-Za-z]+", "a", re.sub(r"[0-9]+", "9", s))
    f = ["bias", f"digits={min(digits, 20)}", f"letters={'none' if not letters else 'all' if letters == len(s) else 'some'}", f"shape={shape[:24]}", f"length={min(len(s) // 8, 8)}"]
    f += [f"first={'9' if s[0].isdigit() else 'a' if s[0].isalpha() else s[0]}", f"last={'9' if s[-1].isdigit() else 'a' if s[-1].isalpha() else s[-1]}"]
    f += [f"touches={before.isalnum() or before in '+@.-' and before != ''}|{after.isalnum() or after in '@-' and after != ''}"]
    low = s.lower()
    if "@" in s:
        f.append(f"at={s.count('@')}")
    if re.fullmatch(r"[a-z0-9._%+-]+ ?[\[({<] ?at ?[\])}>] ?[a-z0-9-]+(?: ?(?:\.|[\[({<] ?dot ?[\])}>]) ?[a-z0-9-]+)+", low) or re.fullmatch(r"[a-z0-9._%+-]+ at [a-z0-9-]+(?: dot [a-z0-9-]+)+", low):
        f += ["spelled mail", f"spelled {'in brackets' if low.count('[') + low.count('(') + low.count('{') + low.count('<') else 'in words'}"]
    groups = re.findall(r"[0-9]+", s)
    if digits and not letters:
        f.append(f"groups={','.join(str(len(g)) for g in groups)[:12]}")
        if 13 <= digits <= 19:
            f.append(f"luhn={luhn(''.join(groups))}")
        if s.count(".") == 3 and len(groups) == 4:
            f.append(f"octets={all(len(g) < 4 and int(g) <= 255 for g in groups)}")
    m = re.match(r"(token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key) ?[=:] ?[\"']?", low)
    if m:
        rest = s[m.end() :].strip("\"'")
        f.append(f"assigned={min(len(rest) // 8, 4)}|{any(c.isdigit() for c in rest)}|{rest.isalnum()}")
    return f


class SegmentField:
    """The semi-Markov field: weights by (kind, feature); tokens outside spans score nothing."""

    def __init__(self, weights: dict[tuple[str, str], float] | None = None) -> None:
        self.w = defaultdict(float, weights or {})

    @staticmethod
    def segments(text: str, a: int, b: int, taken: Iterable[Span] = ()) -> tuple[list[int], list[tuple[int, int, list[str]]]]:
        """Token bounds of a region and its candidate segments (first token, token after, features), those that touch a
        span of ``taken`` (in order of start and end) left out."""
        cuts = [a + m.start() for m in _TOKEN.finditer(text[a:b])] + [b]
        spans, at, free = list(taken), 0, []  # whether a token touches no taken span
        for i in range(len(cuts) - 1):
            while at < len(spans) and spans[at][2] <= cuts[i]:
                at += 1
            free.append(at == len(spans) or spans[at][1] >= cuts[i + 1])
        out = []
        for i in range(len(cuts) - 1):
            if not free[i] or text[cuts[i]].isspace() or text[cuts[i]] in ".,;:)]}\"'=-":
                continue
            digits = marks = False
            for j in range(i + 1, min(i + MOST_TOKENS, len(cuts) - 1) + 1):
                if not free[j - 1]:
                    break
                t = text[cuts[j - 1] : cuts[j]]
                digits, marks = digits or t[0].isdigit() and len(t) > 1, marks or t in ("@", "=", ":") or t.lower() in ("at", "dot")
                if t.isspace() or t in ".,;:([{=-+" or not (digits or marks) or cuts[j] - cuts[i] < 7:
                    continue
                s = text[cuts[i] : cuts[j]]
                if marks or sum(c.isdigit() for c in s) >= 7 and not any(c.isalpha() for c in s):
                    out.append((i, j, segment_features(text, cuts[i], cuts[j])))
        return cuts, out

    def score(self, kind: str, feats: Iterable[str]) -> float:
        return sum(self.w[kind, x] for x in feats if (kind, x) in self.w)

    def decode(self, text: str, a: int, b: int, taken: list[Span]) -> list[Span]:
        """The best spans of a region beside those ``taken``, which lie in it in the order of their starts."""
        cuts, segs = self.segments(text, a, b, taken)
        best, back = [0.0] * len(cuts), [None] * len(cuts)
        by_end: dict[int, list] = defaultdict(list)
        for i, j, f in segs:
            v, n = max((self.score(k, f), -n) for n, k in enumerate(KINDS))
            if v > 0:
                by_end[j].append((i, KINDS[-n], v))
        for j in range(1, len(cuts)):
            best[j] = best[j - 1]
            for i, k, v in by_end.get(j, ()):
                if best[i] + v > best[j]:
                    best[j], back[j] = best[i] + v, (i, k)
        out, j = [], len(cuts) - 1
        while j > 0:
            if back[j]:
                i, k = back[j]
                if k in ADDED:
                    out.append((k, cuts[i], cuts[j]))
                j = i
            else:
                j -= 1
        return out[::-1]

    def train(self, examples: list[tuple[str, list[Span]]], rounds: int = 10, rate: float = 0.4, decay: float = 1e-4) -> None:
        """Stochastic gradient ascent: features seen in the truth less those expected under the field."""
        ready = []
        for text, truth in examples:
            cuts, segs = self.segments(text, 0, len(text))
            at = {c: n for n, c in enumerate(cuts)}
            ready.append((len(cuts), segs, {(at[s], at[e]): k for k, s, e in truth if s in at and e in at}))
        for r in range(rounds):
            step = rate / (1 + r)
            for n, segs, truth in ready:
                scored = [(i, j, f, [self.score(k, f) for k in KINDS]) for i, j, f in segs]
                fore, aft = [0.0] + [-math.inf] * (n - 1), [-math.inf] * (n - 1) + [0.0]
                ends, starts = defaultdict(list), defaultdict(list)
                for x in scored:
                    ends[x[1]].append(x)
                    starts[x[0]].append(x)
                for j in range(1, n):
                    fore[j] = _log_sum([fore[j - 1], *(fore[i] + v for i, _, _, vs in ends[j] for v in vs)])
                for i in range(n - 2, -1, -1):
                    aft[i] = _log_sum([aft[i + 1], *(aft[j] + v for _, j, _, vs in starts[i] for v in vs)])
                for i, j, f, vs in scored:
                    for k, v in zip(KINDS, vs, strict=True):
                        g = (truth.get((i, j)) == k) - math.exp(min(0.0, fore[i] + v + aft[j] - fore[-1]))
                        if abs(g) > 1e-4:
                            for x in f:
                                self.w[k, x] += step * (g - decay * self.w[k, x])


def _log_sum(xs: list[float]) -> float:
    m = max(xs)
    return m + math.log(sum(math.exp(x - m) for x in xs)) if m > -math.inf else m


def rewritten(text: str, spans: list[Span]) -> list[tuple[str, list[Span]]]:
    """Copies of a region with one base span in another form that the patterns don't know."""
    out = []
    for kind, a, b in spans:
        s, forms = text[a:b], []
        if kind == "email":
            local, _, domain = s.partition("@")
            forms = [(f"{local} [at] {domain.replace('.', ' [dot] ')}", "obfuscated_email"), (f"{local}(at){domain}", "obfuscated_email"), (f"{local} at {domain.replace('.', ' dot ')}", "obfuscated_email")]
            plain = re.sub(r"[0-9]", "", local).strip("._%+-"), ".".join(x for x in re.sub(r"[0-9]", "", domain).split(".") if x)
            if all(plain) and "." in plain[1]:
                forms += [(f"{plain[0]} [at] {plain[1].replace('.', ' [dot] ')}", "obfuscated_email"), (f"{plain[0]} at {plain[1].replace('.', ' dot ')}", "obfuscated_email")]
        elif kind == "phone":
            digits = "".join(c for c in s if c.isdigit())[-10:]
            if len(digits) == 10:
                forms = [(f"({digits[:3]}) {digits[3:6]}-{digits[6:]}", "national_phone"), (f"{digits[:3]}-{digits[3:6]}-{digits[6:]}", "national_phone"), (f"{digits[:3]} {digits[3:6]} {digits[6:]}", "national_phone")]
        for new, k in forms:
            out.append((text[:a] + new + text[b:], [(k, a, a + len(new))]))
        # Words and numbers that only look alike are no span.
        for new in (f"met at the {domain.replace('.', ' or ')}; the dot was {local}",) if kind == "email" else (f"{s[-7:]} of {s[1:8]}", "12 05 2021, 1234567") if kind == "phone" else ():
            out.append((text[:a] + new + text[b:], []))
    return out


_SECRET = re.compile(rf"{_NAMED} ?[=:] ?[\"']?[A-Za-z0-9+/_\-]{{16,}}(?![A-Za-z0-9+/_\-])[\"']?", re.I)


def fit_field(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", most_rows: int = 1000, most_examples: int = 2000) -> SegmentField:
    """A field trained on the regions of at most ``most_rows`` rows that could have one (by the order of a hash of id and
    text) and on at most ``most_examples`` regions of them.  Only hashes are ordered; the chosen rows are read by them."""

    def cut_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"region": [t[max(a, 0) : min(e, a + 400)] for t in b["text"] for a, e in regions(t)]}, dtype=str)

    rows = docs.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("_key"), F.col(text_col).alias("text"))
    rows = rows.filter(F.col("text").rlike(r"@|[0-9][0-9 ().\-]{7}|(?i:token|secret|passw|pwd|key) ?[=:] ?[\"']?[A-Za-z0-9+/_\-]{8}"))
    keys = [r["_key"] for r in rows.select("_key").orderBy("_key").limit(most_rows).collect()]  # ``most_rows`` numbers at most
    some = rows.filter(F.col("_key").isin(keys) if keys else F.lit(False)).select("text")
    found = sorted(set(some.mapInPandas(cut_out, "region string").toPandas()["region"]), key=lambda s: hashlib.md5(s.encode("utf-8", "replace")).digest())[:most_examples]
    examples = []
    for r in found:
        truth = base_spans(r) + [("secret", *m.span()) for m in _SECRET.finditer(r)]
        truth = [x for x in truth if not any(y is not x and y[1] <= x[1] and x[2] <= y[2] and (y[2] - y[1], y[0]) > (x[2] - x[1], x[0]) for y in truth)]
        examples.append((r, truth))
        if len(truth) == 1:
            examples += rewritten(r, truth)
    field = SegmentField()
    field.train(examples[: 3 * most_examples])
    return SegmentField(dict(field.w))


def all_spans(text: str, field: SegmentField) -> list[Span]:
    """Base spans and those the field adds, by kind as listed, then start."""
    base = base_spans(text)
    in_order = sorted(base, key=lambda s: s[1:])
    added, first = [], 0
    for a, b in regions(text):
        while first < len(in_order) and in_order[first][2] <= a:
            first += 1
        taken, k = [], first
        while k < len(in_order) and in_order[k][1] < b:
            taken.append(in_order[k])
            k += 1
        # Spans of several kinds can overlap: joined, they are in order of both ends.
        joined: list[Span] = []
        for s in taken:
            if joined and s[1] < joined[-1][2]:
                joined[-1] = (joined[-1][0], joined[-1][1], max(s[2], joined[-1][2]))
            else:
                joined.append(s)
        added += field.decode(text, a, b, joined)
    return base + sorted(added, key=lambda s: (KINDS.index(s[0]), s[1]))


def find_pii(docs: DataFrame, field: SegmentField, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone (base spans), base (list of kind:start:end), spans (all)."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(dict(field.w))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = SegmentField(shared.value)
        for b in batches:
            rows = []
            for i, t in zip(b["doc_id"], b["text"], strict=True):
                found = all_spans(t or "", f)  # the field adds no span of a base kind
                counts = [sum(s[0] == k for s in found) for k in BASE]
                told = [f"{k}:{s}:{e}" for k, s, e in found]
                rows.append((i, *counts, ",".join(told[: sum(counts)]), ",".join(told)))
            yield pd.DataFrame(rows, columns=["doc_id", *(f"n_{k}" for k in BASE), "base", "spans"])

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInPandas(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base string, spans string")
