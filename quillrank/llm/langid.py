"""Language identification by interpolated Kneser-Ney character language models.

Text is lower-cased; all but letters become single spaces. Each language has a model of order `ORDER` with absolute
discounts per order and continuation counts below the highest order. All models share one sorted array of n-gram
hashes per order, and one of contexts, with a column per language, so a text's n-grams are looked up once for all
languages; in a batch each distinct n-gram is scored once. The language with the lowest cross-entropy per character
wins; `score` is its share in a softmax over the cross-entropies. A text is rejected when it has no letters, or when its best
cross-entropy lies more than `reject_sd` deviations above the mean of its language, with 6 / sqrt(characters) allowed on top, so that short
texts stay. Mean and deviation are those of texts that the models they are scored by have not seen: a fifth of the drawn ones,
scored by models of the rest (of all languages together where a language has few).

Fitting takes about `per_lang` different texts of each language (`lang` is a column of few values), drawn by a hash of doc_id and text; of a text
beyond `fit_chars` characters pieces from its beginning to its end are learned. Scoring covers every whole text. Null or letterless texts
give `und` with score 0; a null lang is not learned; of languages with equal cross-entropy the first by name wins; repeated rows score
alike; other columns are ignored, or passed through untouched under any name; an empty table, or one without labels, gives `und` for every row.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import excerpt, id_crc32, map_batches, rows_of, seeded, table

ORDER, PER_LANG, FIT_CHARS, REJECT_SD, CALIBRATE = 4, 1200, 10_000, 8.0, 5
_K, _SPACE = np.uint64(0x9E3779B97F4A7C15), 32


@functools.cache
def _letter() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def letters(text: str | None, order: int = ORDER) -> np.ndarray | None:
    """Code points of the folded text, with order - 1 leading spaces and one behind; None without letters."""
    if not text:
        return None
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    keep = _letter()[codes]
    if not keep.any():
        return None
    codes = np.where(keep, codes, _SPACE)
    keep[1:] |= keep[:-1]  # the first of each run of spaces stays
    codes = codes[keep]
    codes = codes[int(codes[0] == _SPACE) :]
    tail = [] if codes[-1] == _SPACE else [_SPACE]
    return np.concatenate((np.full(order - 1, _SPACE), codes, tail)).astype(np.uint64)


def _hashes(codes: np.ndarray, order: int) -> list[np.ndarray]:
    """H[k][i]: hash of the k characters from i on; H[0] is unused."""
    out = [np.zeros(0, np.uint64), codes + np.uint64(1)]
    for k in range(2, order + 1):
        out.append(out[-1][:-1] * _K + codes[k - 1 :] + np.uint64(1))
    return out


def _fold(rows: np.ndarray) -> np.ndarray:
    """The hash of each column of characters, as _hashes has it; zeros for no characters."""
    h = np.zeros(rows.shape[1], np.uint64)
    for i, r in enumerate(rows):
        h = h * _K + r + np.uint64(1) if i else r + np.uint64(1)
    return h


def _grams(texts: list[str], order: int, chars: int = 400_000) -> tuple[np.ndarray, np.ndarray]:
    """The different n-grams of some texts, a column of characters each, and how often each occurs; counted about `chars` characters at a time."""
    keys, counts, rows = [], [], []
    held, size = [], 0

    def count() -> None:
        codes = np.concatenate(held) if held else np.full(order, _SPACE, np.uint64)
        key, at, n = np.unique(_hashes(codes, order)[order], return_index=True, return_counts=True)
        keys.append(key)
        counts.append(n)
        rows.append(np.stack([codes[at + i] for i in range(order)]))

    for t in texts:
        if (codes := letters(t, order)) is None:
            continue
        held.append(codes)
        size += len(codes)
        if size > chars:
            count()
            held, size = [], 0
    if held or not keys:
        count()
    _, first, back = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    return np.concatenate(rows, axis=1)[:, first], np.bincount(back, np.concatenate(counts)).astype(np.int64)


class Models:
    """Models of several languages in shared sorted hash arrays."""

    def __init__(self, texts: dict[str, list[str]], order: int = ORDER, reject_sd: float | None = REJECT_SD) -> None:
        self.order = order
        self.langs = sorted(texts)
        n = len(self.langs)
        self.reject_at = np.full(n, np.inf)
        if n and reject_sd is not None:
            self._calibrate(texts, reject_sd)  # its models are gone before these are built
        grams: list[list] = [[] for _ in range(order + 1)]
        contexts: list[list] = [[] for _ in range(order + 1)]
        alphabet: set[int] = set()
        for lang in self.langs:
            rows, count = _grams(texts[lang], order)
            alphabet |= set(np.unique(rows).tolist())
            for k in range(order, 0, -1):
                key, context = _fold(rows), _fold(rows[:-1])
                ones, twos = int((count == 1).sum()), int((count == 2).sum())
                d = min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones + twos else 0.5
                own, back = np.unique(context, return_inverse=True)
                total = np.bincount(back, count)
                grams[k].append((key, (count - d).clip(0) / total[back]))
                contexts[k].append((own, d * np.bincount(back) / total))
                if k > 1:  # continuation counts of the suffixes
                    _, first, count = np.unique(_fold(rows[1:]), return_index=True, return_counts=True)
                    rows = rows[1:, first]
        self.uniform = 1.0 / (len(alphabet) + 1)
        self.grams, self.contexts = [None], [None]
        for k in range(1, order + 1):
            for parts, to, rest in ((grams[k], self.grams, 0.0), (contexts[k], self.contexts, 1.0)):
                keys = np.unique(np.concatenate([p[0] for p in parts])) if parts else np.zeros(0, np.uint64)
                values = np.full((len(keys) + 1, n), rest, np.float32)  # the last row is for what was never seen
                for j, (key, v) in enumerate(parts):
                    values[np.searchsorted(keys, key), j] = v
                to.append((keys, values))

    def _calibrate(self, texts: dict[str, list[str]], reject_sd: float) -> None:
        """Thresholds of rejection from every CALIBRATE-th text, by models of the others."""
        kept = {lang: [t for i, t in enumerate(own) if i % CALIBRATE] or own for lang, own in texts.items()}
        other = Models(kept, self.order, None)
        held = {lang: [h for _, _, h, _ in other.classify(own[::CALIBRATE]) if h > 0] for lang, own in texts.items()}
        every = [h for own in held.values() for h in own]
        for j, lang in enumerate(self.langs):
            own = np.array(held[lang] if len(held[lang]) >= 20 else every)
            if len(own):
                self.reject_at[j] = own.mean() + reject_sd * max(own.std(), 0.05)

    def _log_p(self, h: list[np.ndarray], at: np.ndarray) -> np.ndarray:
        """log P of the last of the `order` characters from each position on, by language."""
        p = np.full((len(at), len(self.langs)), self.uniform, np.float32)
        for k in range(1, self.order + 1):
            end = at + self.order - k
            for (keys, values), key, what in ((self.contexts[k], h[k - 1][end] if k > 1 else np.zeros(len(at), np.uint64), "c"), (self.grams[k], h[k][end], "g")):
                j = np.searchsorted(keys, key)
                j[(j == len(keys)) | (keys[np.minimum(j, len(keys) - 1)] != key)] = len(keys)
                p = p * values[j] if what == "c" else p + values[j]
        return np.log(np.maximum(p, 1e-12))

    def classify(self, texts: list[str | None], chars: int = 200_000) -> list[tuple[str, float, float, bool]]:
        """(language, score, cross-entropy, rejected) of each text."""
        out: list[tuple[str, float, float, bool]] = [("und", 0.0, 0.0, True)] * len(texts)
        if not self.langs:
            return out
        held: list[tuple[int, np.ndarray]] = []
        size = 0
        for i, text in enumerate(texts):
            if (codes := letters(text, self.order)) is None:
                continue
            held.append((i, codes))
            size += len(codes)
            if size > chars:
                self._some(held, out)
                held, size = [], 0
        if held:
            self._some(held, out)
        return out

    def _some(self, held: list[tuple[int, np.ndarray]], out: list) -> None:
        h = _hashes(np.concatenate([c for _, c in held]), self.order)
        size = np.array([len(c) for _, c in held])
        start = np.concatenate(([0], np.cumsum(size)[:-1]))
        n = size - self.order + 1
        at = np.arange(n.sum()) + np.repeat(start - np.concatenate(([0], np.cumsum(n)[:-1])), n)
        _, first, back = np.unique(h[self.order][at], return_index=True, return_inverse=True)
        each = self._log_p(h, at[first])[back]
        mean = np.add.reduceat(each, np.concatenate(([0], np.cumsum(n)[:-1])), axis=0, dtype=np.float64) / n[:, None]
        best = mean.argmax(1)
        heat = np.minimum(n, 20)[:, None]
        share = 1 / np.exp((mean - mean.max(1, keepdims=True)) * heat).sum(1)
        for k, (i, _) in enumerate(held):
            h_best = -float(mean[k, best[k]])
            out[i] = (self.langs[best[k]], float(share[k]), h_best, bool(h_best > self.reject_at[best[k]] + 6 / n[k] ** 0.5))


def fit(docs: DataFrame, per_lang: int = PER_LANG, fit_chars: int = FIT_CHARS) -> Models:
    """Models from documents that are not held out, a bounded sample of each language."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (id_crc32() % 5 != 0))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return Models({})
    rate = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, per_lang / n)])
    drawn = rows.filter(seeded("langid", "doc_id", "text") < F.element_at(rate, F.col("lang")))
    # repeated rows fall alike under the hash: each text counts once
    texts: dict[str, list[str]] = {}
    for lang, text in sorted((r.lang, r.text) for r in drawn.select("lang", excerpt(F.col("text"), fit_chars).alias("text")).distinct().collect()):
        texts.setdefault(lang, []).append(text)
    return Models(texts)


def identify(docs: DataFrame, models: Models, keep: list[Column] | None = None) -> DataFrame:
    """docs scored; keep: columns to pass through instead of doc_id alone."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(models)  # bounded by per_lang documents of each language

    def make():
        m = shared.value

        def run(batch: pa.RecordBatch) -> dict:
            lang, score, h, rejected = zip(*m.classify(rows_of(batch, "_text")), strict=True)
            return {c: batch.column(i) for i, c in enumerate(batch.schema.names) if c != "_text"} | {"lang_pred": lang, "score": score, "cross_entropy": h, "rejected": rejected}

        return run

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (id_crc32() % 5 == 0).alias("held_out"), F.col("text").alias("_text")) if keep is None else docs.select(*keep, F.col("text").alias("_text"))
    more = T._parse_datatype_string("lang_pred string, score double, cross_entropy double, rejected boolean")
    return map_batches(base, make, T.StructType([*base.drop("_text").schema.fields, *more.fields]))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs))
