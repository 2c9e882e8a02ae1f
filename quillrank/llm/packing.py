"""Packing documents into sequences: byte-level BPE, then shortest-pack-first over the length histogram.

A document of n tokens gives n // size whole sequences and one shorter piece; the cut depends on the document alone, so
tokenization is one narrow pass and tokens are never stored. The histogram of piece lengths (at most `size` rows) is
packed on the driver: lengths longest first, each into the open packing pattern with the most room, updating pattern
counts, so the work depends on the number of lengths, not of documents. Pieces of a length are numbered by the task that cuts them and, by
the counts of (length, task), across tasks: no rows are sorted, however many have one length. The rank finds the pattern, the sequence
and the offset.

Tokenization cuts a text at single spaces between other characters, where the pre-tokenizer always starts a token, and
remembers the ids of up to CACHE such pieces. Ids are the tokenizer's own (a test holds them against it).

A null or empty text is the end id alone; pieces of one length stand in the order of the table; repeated rows are packed each; an empty
table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import heapq
import os
import re
import zlib
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, rows_of, staged, starts, table

SIZE, END_ID, CACHE = 2048, 1, 200_000
PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long"
_CUT = re.compile(r"(?<=\S) (?=\S)")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _fast(path: str):
    """A tiktoken encoding of the same vocabulary, where the file is plain byte-level BPE whose ids follow its merges; else None."""
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model["type"] == "BPE" and spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    if not plain or model.get("dropout") or model.get("ignore_merges") or model.get("unk_token") or model.get("end_of_word_suffix") or model.get("continuing_subword_prefix"):
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    vocab = model["vocab"]
    if sorted(vocab[c] for c in byte if c in vocab) != list(range(256)) or [vocab.get(a + b) for a, b in merges] != list(range(256, 256 + len(merges))):
        return None
    ranks = {bytes(byte[c] for c in token): i for token, i in vocab.items() if i < 256 + len(merges)}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("same", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class Ids:
    """Token ids of texts as little-endian uint32 bytes, by a tokenizer file.

    Pieces of Latin letters go to a faster encoder of the same vocabulary and merges; all others to the tokenizer itself, one at a time and in one thread."""

    def __init__(self, path: str, cache: int = CACHE) -> None:
        self.path, self.cache = path, cache
        self.known: dict[str, bytes] = {}
        self.fast = _fast(path)

    @functools.cached_property
    def tokenizer(self):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(self.path)
        t.encode_special_tokens = True
        return t

    def _one(self, piece: str) -> bytes:
        if self.fast is not None and (piece.isascii() or max(piece) < "\u0250"):
            return array("I", self.fast.encode_ordinary(piece)).tobytes()
        return array("I", self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()

    def _text(self, text: str) -> bytes:
        known, out = self.known, []
        parts = text.split(" ")
        parts[1:] = [" " + p for p in parts[1:]]
        for i, p in enumerate(parts):
            if (got := known.get(p)) is None:
                body = p[1:] if i else p
                if not body or body[0].isspace() or body[-1].isspace():
                    return b"".join([self._one(p) for p in self._safe(text)])
                if len(known) >= self.cache:
                    known.clear()
                got = self._one(p)
                if len(p) <= 64:
                    known[p] = got
            out.append(got)
        return b"".join(out)

    def _safe(self, text: str) -> list[str]:
        """Pieces of a text where white space stands beside a space or at an end."""
        first, *rest = _CUT.split(text)
        return [first, *(" " + p for p in rest)]

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        return [self._text(t) if t else b"" for t in texts]


def token_pieces(docs: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece of every document, with its task and its place among the task's pieces of the same length."""
    end = np.asarray([end_id], "<u4").tobytes()

    def make():
        ids, task, turns = Ids(tokenizer), TaskContext.get().partitionId(), Counter()

        def run(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "_task", "_turn")}
            for key, raw in zip(rows_of(batch, "doc_id"), ids(rows_of(batch, "text")), strict=True):
                raw += end
                n = len(raw) // 4
                for start in range(0, n, size):
                    piece = raw[4 * start : 4 * (start + size)]
                    length = len(piece) // 4
                    for k, v in (("doc_id", key), ("start", start), ("length", length), ("ids_crc32", zlib.crc32(piece)), ("doc_tokens", n), ("_task", task), ("_turn", turns[length])):
                        out[k].append(v)
                    turns[length] += 1
            return out

        return run

    return map_batches(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), make, f"{PIECES}, _task int, _turn long")


def shortest_pack_first(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, tuple[int, ...]]]:
    """(count, lengths) of the packing patterns for a histogram of lengths up to size."""
    room: list[tuple[int, int]] = []  # (-room, number of the pattern): most room first
    held: dict[int, tuple[int, tuple[int, ...]]] = {}
    done: list[tuple[int, tuple[int, ...]]] = []
    serial = 0

    def put(count: int, lengths: tuple[int, ...], left: int) -> None:
        nonlocal serial
        if left == 0:
            done.append((count, lengths))
        else:
            held[serial] = (count, lengths)
            heapq.heappush(room, (-left, serial))
            serial += 1

    for length in sorted(histogram, reverse=True):
        todo = histogram[length]
        while todo:
            if not room or -room[0][0] < length:
                put(todo, (length,), size - length)
                break
            left, key = heapq.heappop(room)
            count, lengths = held.pop(key)
            used = min(count, todo)
            if count > used:
                held[key] = (count - used, lengths)
                heapq.heappush(room, (left, key))
            put(used, (*lengths, length), -left - length)
            todo -= used
    return done + [held[k] for k in sorted(held)]


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None, size: int = SIZE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every piece with its sequence and offset."""
    pieces = staged(spark, token_pieces(docs, tokenizer or default_tokenizer(), size, doc_id=doc_id, text=text), "pack-pieces")
    counts = staged(spark, starts(pieces, "length"), "pack-starts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # size rows at most
    segments: dict[int, list[tuple[int, int, int]]] = {}  # of a length: first rank, first sequence, offset
    first, used = 0, Counter()
    for count, lengths in shortest_pack_first(histogram, size):
        offset = 0
        for length in lengths:
            segments.setdefault(length, []).append((used[length], first, offset))
            used[length] += count
            offset += length
        first += count
    lookup = {k: tuple(np.asarray(x, np.int64) for x in zip(*v, strict=True)) for k, v in segments.items()}
    rank = (F.col("_first") + F.col("_turn")).cast("long").alias("rank")
    ranked = pieces.join(counts, ["length", "_task"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", rank)

    def make():
        def run(batch: pa.RecordBatch) -> dict:
            out = {k: batch.column(batch.schema.get_field_index(k)) for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")}
            length, rank = (batch.column(batch.schema.get_field_index(k)).to_numpy() for k in ("length", "rank"))
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for k in np.unique(length):
                at = np.flatnonzero(length == k)
                ranks, seqs, offs = lookup[int(k)]
                j = np.searchsorted(ranks, rank[at], "right") - 1
                sequence[at], offset[at] = seqs[j] + rank[at] - ranks[j], offs[j]
            return out | {"sequence_id": sequence, "offset": offset}

        return run

    return map_batches(ranked, make, f"{PIECES}, sequence_id long, offset long")


def op10_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, table(spark, sf_dir, "documents"))
