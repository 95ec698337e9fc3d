"""Token ids in word-aligned binary files (Simple-8b).

A file holds the ids of consecutive documents.  Ids are packed by Simple-8b: a 64-bit little-endian word has a 4-bit
selector in its low bits and as many ids of equal width as fit the other 60; ids of 60 bits and more cannot occur, ids
too wide for the widest useful packing go through the escape selector with one id a word.  Words are grouped in blocks
of ``block_ids`` ids, and the file ends with the block offsets, so that a block is decoded alone and in a few numpy
steps.  Layout:

    "S8B1" | words of all blocks | per document: id (int64), ids (int64) | per block: first word (int64) |
    documents, blocks, ids, block_ids (int64 each)

Rows: a null text counts as an empty one (the end id alone); documents go by ascending id, null first, ties by the
text; repeated rows are written again; an empty table gives no file and no rows.
"""

from __future__ import annotations

import operator
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from petrilens.llm.common import bounded_batches, cut, fresh_path, hand_back, handing_back

#: Selector -> (ids in a word, bits of an id); selector 0 is the escape: one id of up to 60 bits.
PACKINGS = ((1, 60), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30))
_MAGIC = b"S8B1"
_BY_COUNT = sorted(((n, b, s) for s, (n, b) in enumerate(PACKINGS) if s), reverse=True)


def encode_block(ids: np.ndarray) -> np.ndarray:
    """Simple-8b words of the ids, packed greedily: each word takes the packing with the most ids that fit."""
    x = ids.astype(np.uint64)
    n = len(x)
    if n and int(x.max()) >> 60:
        raise ValueError("an id needs more than 60 bits")
    need = np.frexp(x.astype(np.float64))[1].astype(np.int8)  # bits of each id; from 2^53 on, one more at most
    best_n, best_s = np.ones(n, np.uint8), np.zeros(n, np.uint8)
    widest, k = need.copy(), 1  # widest[i]: most bits among the ids i to i + k - 1
    for count, bits, sel in reversed(_BY_COUNT):
        if count > n:
            break
        while k < count:
            widest = np.maximum(widest[:-1], need[k:])
            k += 1
        ok = np.flatnonzero(widest <= bits)
        best_n[ok], best_s[ok] = count, sel
        if not len(ok) and widest.min() > bits:
            break
    starts, i, jump = [], 0, best_n.tobytes()
    while i < n:
        starts.append(i)
        i += jump[i]
    at = np.array(starts, np.int64)
    sel = best_s[at]
    words = np.zeros(len(at), np.uint64)
    for s in np.unique(sel):
        k = np.flatnonzero(sel == s)
        count, bits = PACKINGS[s]
        first, word = at[k], np.full(len(k), s, np.uint64)
        for j in range(count):
            word |= x[first + j] << np.uint64(4 + j * bits)
        words[k] = word
    return words


def decode_words(words: np.ndarray) -> np.ndarray:
    """The ids of whole words."""
    sel = (words & np.uint64(15)).astype(np.int64)
    counts = np.array([n for n, _ in PACKINGS], np.int64)[sel]
    at = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros(at[-1], np.uint64)
    for s in np.unique(sel):
        n, bits = PACKINGS[s]
        k = np.flatnonzero(sel == s)
        for j in range(n):
            out[at[k] + j] = (words[k] >> np.uint64(4 + j * bits)) & np.uint64((1 << bits) - 1)
    return out


def file_bytes(doc_ids: list[int], counts: list[int], parts: list[np.ndarray], block_ids: int) -> bytes:
    """A whole file of documents with ``counts`` ids each; ``parts`` hold their ids in order."""
    ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    blocks = [encode_block(ids[a : a + block_ids]) for a in range(0, len(ids), block_ids)]
    offsets = np.cumsum([0, *map(len, blocks)])[:-1]
    table = np.array([doc_ids, counts], np.int64).T if doc_ids else np.zeros((0, 2), np.int64)
    tail = np.array([len(doc_ids), len(blocks), len(ids), block_ids], np.int64)
    return b"".join([_MAGIC, *(b.astype("<u8").tobytes() for b in blocks), table.astype("<i8").tobytes(), offsets.astype("<i8").tobytes(), tail.astype("<i8").tobytes()])


def read_file(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, their numbers of ids, and all ids of a file."""
    if data[:4] != _MAGIC:
        raise ValueError("not a token file")
    n_docs, n_blocks, n_ids, block_ids = np.frombuffer(data, "<i8", 4, len(data) - 32).tolist()
    at = len(data) - 32 - 8 * n_blocks
    offsets = np.frombuffer(data, "<i8", n_blocks, at)
    table = np.frombuffer(data, "<i8", 2 * n_docs, at - 16 * n_docs).reshape(-1, 2)
    words = np.frombuffer(data, "<u8", (at - 16 * n_docs - 4) // 8, 4)
    bounds = [*offsets.tolist(), len(words)]
    out, n = np.zeros(n_ids, np.uint64), 0
    for a, b in zip(bounds, bounds[1:], strict=False):
        ids = decode_words(words[a:b])
        out[n : n + len(ids)] = ids[: max(n_ids - n, 0)]
        n += len(ids)
    if n != n_ids:
        raise ValueError("a token file is damaged")
    return table[:, 0], table[:, 1], out


_SPLIT = re.compile(r"(?<=\S) (?=\S)")
#: Texts that are not cut at every space and line end: other white space, and runs or ends of white space.
_ODD = r"[\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|[ \n]{2}|^[ \n]|[ \n]$"
#: Characters of text that are cut up and looked up together.
_CHUNK = 4 << 20


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class _Letters(dict):
    """Code point -> its bytes in the vocabulary's alphabet, as the tokenizer's own pre-tokenizer writes them."""

    def __init__(self, tok) -> None:
        super().__init__()
        self.tok = tok

    def __missing__(self, code: int) -> str:
        made = self[code] = self.tok.pre_tokenizer.pre_tokenize_str(chr(code))[0][0]
        return made


#: Latin letters, perhaps with ASCII punctuation behind them: two pre-tokens of the vocabulary's pattern.
_SIMPLE = r"^(?P<core>[A-Za-z\x{aa}\x{b5}\x{ba}\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]+)(?P<tail>[!-/:-@\[-^`{-~]*)$"


class Encoder:
    """Token ids of whole texts by a byte-level BPE of the tokenizers library.

    Its pre-tokenizer always cuts before a single space, and around a single line end, that stand between two other
    characters, and merges never cross such a cut; so a text is encoded piece by piece, and pieces met before are
    looked up.  Texts with longer or other white space are cut at single spaces only; texts that hold one of the
    vocabulary's special strings are encoded whole.
    """

    def __init__(self, path: str, most_kept: int = 500_000) -> None:
        self.tok, self.most_kept = _tokenizer(path), most_kept
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.plain = type(self.tok.pre_tokenizer).__name__ == "ByteLevel" and self.tok.normalizer is None and not self.tok.pre_tokenizer.add_prefix_space
        self.line_end, self.letters, self.merge = self._whole("\n"), _Letters(self.tok), self.tok.model.tokenize
        self.words: dict[str, bytes] = {}  # single pre-tokens, a space in front where the text has one
        self.others: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()

    def _word(self, word: str) -> bytes:
        """A single pre-token goes straight to the merges."""
        return array("I", [t.id for t in self.merge(word.translate(self.letters))]).tobytes()

    @staticmethod
    def _look_up(kept: dict[str, bytes], keys: list[str], make, most: int) -> list[bytes]:
        """What is kept under the keys, made where it is new; a full lookup starts afresh with these keys."""
        found = list(map(kept.get, keys))
        if None in found:
            for i, f in enumerate(found):
                if f is None:
                    found[i] = kept[keys[i]] = make(keys[i])
        if len(kept) > most:
            kept.clear()
            kept.update(zip(keys, found, strict=True))
        return found

    def _pieces(self, pieces: pa.Array, spaced: bool) -> tuple[list[bytes], np.ndarray]:
        """The ids of distinct pieces, all after a space or none, and which piece each of them is."""
        before = " " if spaced else ""
        parts = pc.extract_regex(pieces, _SIMPLE)
        simple = parts.is_valid().to_numpy(zero_copy_only=False)
        core, tail = (x.dictionary_encode() for x in parts.filter(parts.is_valid()).flatten())
        cores = self._look_up(self.words, [before + w for w in core.dictionary.to_pylist()], self._word, self.most_kept)
        tails = self._look_up(self.others, tail.dictionary.to_pylist(), self._whole, self.most_kept)
        made = list(map(operator.add, map(cores.__getitem__, core.indices.to_pylist()), map(tails.__getitem__, tail.indices.to_pylist())))
        rest = np.flatnonzero(~simple)
        whole = self._look_up(self.others, [before + w for w in pieces.take(pa.array(rest)).to_pylist()], self._whole, self.most_kept)
        return made + whole, np.concatenate([np.flatnonzero(simple), rest])

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_all(pa.array([text], pa.string()))[0]

    def encode_all(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; null has none."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        out, a = [], 0
        while a < len(texts):
            b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + _CHUNK, "right")))
            out += self._chunk(texts.slice(a, b - a))
            a = b
        return out

    def _chunk(self, texts: pa.Array) -> list[np.ndarray]:
        if not self.plain:
            return [np.frombuffer(self._whole(t), np.uint32) for t in texts.to_pylist()]
        odd = pc.match_substring_regex(texts, "|".join([_ODD, *map(re.escape, self.special)]))
        lines = pc.split_pattern(pc.if_else(odd, "", texts), "\n")
        words = pc.split_pattern(lines.flatten(), " ")
        coded = words.flatten().dictionary_encode()
        code, pieces = coded.indices.to_numpy(), coded.dictionary
        n = len(pieces)
        first_line, first_word = lines.offsets.to_numpy() - lines.offsets[0].as_py(), words.offsets.to_numpy() - words.offsets[0].as_py()
        key = code.astype(np.int32)  # after a space; + n at a line's start, + 2 n at a text's start
        key[first_word[:-1]] += n
        key[first_word[first_line[:-1]]] += n
        asked = np.zeros(3 * n, bool)
        asked[key] = True
        after_space, at_start = np.flatnonzero(asked[:n]), np.flatnonzero(asked[n : 2 * n] | asked[2 * n :])
        bare, bare_at = self._pieces(pieces.take(pa.array(at_start)), False)
        made, made_at = self._pieces(pieces.take(pa.array(after_space)), True)
        made = made + [self.line_end + b for b in bare] + bare
        asked = np.concatenate([after_space[made_at], at_start[bare_at] + n, at_start[bare_at] + 2 * n])
        ids = np.frombuffer(b"".join(made), np.uint32)
        size = np.fromiter(map(len, made), np.int32, len(made)) // 4
        slot = np.zeros(3 * n, np.int32)
        slot[asked] = np.arange(len(asked), dtype=np.int32)
        at = slot[key]
        counts = size[at]
        ends = np.cumsum(counts)
        place = np.int64 if len(ends) and max(ends[-1], len(ids)) >> 31 else np.int32
        take = np.repeat(((np.cumsum(size) - size)[at] - (ends - counts)).astype(place), counts)
        take += np.arange(len(take), dtype=place)
        bounds = np.concatenate([[0], ends])[first_word[first_line]]
        all_ids = ids[take]
        out = [all_ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
            out[i] = np.frombuffer(self._odd(texts[i].as_py()), np.uint32)
        return out

    def _odd(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self._whole(text)
        parts = _SPLIT.split(text)
        return self._whole(parts[0]) + b"".join(self._look_up(self.others, [" " + p for p in parts[1:]], self._whole, self.most_kept))


def _write(path: str, data: bytes) -> None:
    from pyarrow import fs

    store, p = fs.FileSystem.from_uri(path)
    with store.open_output_stream(p) as f:
        f.write(data)


def _read(path: str) -> bytes:
    from pyarrow import fs

    store, p = fs.FileSystem.from_uri(path)
    with store.open_input_stream(p) as f:
        return f.read()


def write_token_files(
    docs: DataFrame, out_dir: str, *, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, partitions: int | None = None, file_ids: int = 1 << 21, block_ids: int = 1 << 14
) -> DataFrame:
    """Writes the token files of ``docs`` below ``out_dir`` and returns their manifest, in checkpoint.

    Documents are dealt by ranges of their id and sorted in a range, so the files in manifest order hold the ids in
    ascending document order.  A task closes a file after ``file_ids`` ids.  Every attempt of a task writes files with
    names of its own; the manifest names those of the attempt that counted: part, file, path, n_docs, n_ids.
    """
    bounded_batches(docs.sparkSession, 3000)
    n = partitions or max(1, docs.rdd.getNumPartitions())
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, attempt = _encoder(tokenizer), TaskContext.get().partitionId(), uuid.uuid4().hex
        ids, held, size, k = [], [], 0, 0
        end = np.array([end_id], np.uint32)

        def close() -> pa.RecordBatch:
            path = f"{out_dir}/part-{part:06d}-{k:05d}-{attempt}.s8b"
            _write(path, file_bytes(ids, [len(x) + 1 for x in held[::2]], held, block_ids))
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": pa.array([k], pa.int32()), "path": [path], "n_docs": [len(ids)], "n_ids": [size]})

        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), encoder.encode_all(b.column(1)), strict=True):
                ids.append(-(2**63) if i is None else i)
                held += [x, end]
                size += len(x) + 1
                if size >= file_ids:
                    yield close()
                    ids, held, size, k = [], [], 0, k + 1
                    hand_back()
        if ids:
            yield close()

    return cut(rows.mapInArrow(handing_back(run), "part int, file int, path string, n_docs long, n_ids long"))


@lru_cache(maxsize=4)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Per document of the files, from the files: doc_id, start, n_tokens, ids_crc32 (of its ids as little-endian
    unsigned 32-bit integers), ids are decoded a file at a time.  A null id was written as the least long."""
    before = Window.partitionBy().orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, base in zip(b["path"], b["base"], strict=True):
                names, counts, ids = read_file(_read(path))
                ends = np.cumsum(counts)
                raw = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(raw[4 * (e - c) : 4 * e]) for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
                who = pd.array(names, dtype="Int64")
                who[names == -(2**63)] = pd.NA
                yield pd.DataFrame({"doc_id": who, "start": base + ends - counts, "n_tokens": counts, "ids_crc32": np.array(crc, np.int64)})

    spread = files.repartition(max(1, min(files.count(), 4096)), "part", "file")
    return spread.mapInPandas(handing_back(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, *, tokenizer: str, out_dir: str | None = None, **params) -> DataFrame:
    """Writes the files (by default to a new folder in the shared one) and reads them back: see read_token_files."""
    if out_dir is None:
        out_dir = fresh_path(docs.sparkSession, "tokens")
    if out_dir.startswith("file:") or "://" not in out_dir:
        out_dir = out_dir if "://" in out_dir else f"file://{os.path.abspath(out_dir.removeprefix('file:'))}"
    _make_dir(out_dir)
    return read_token_files(write_token_files(docs, out_dir, tokenizer=tokenizer, **params))


def _make_dir(path: str) -> None:
    from pyarrow import fs

    store, p = fs.FileSystem.from_uri(path)
    store.create_dir(p, recursive=True)
