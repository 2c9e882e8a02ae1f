"""Toxicity by a weighted lexicon that an Aho-Corasick automaton matches in folded text.

Folding: case, accents and compatibility forms, homoglyphs (Cyrillic and Greek look-alikes), digits and signs that stand for letters inside
words (1d10t, $cum); everything else that is no letter becomes a space. Entries are whole words or word beginnings, with
their smoothed log-odds as weights, in `SUPPORT` toxic rows at least and more of them than chance gives any of the candidates (`CHANCE`,
by Chernoff's bound over all candidates), so that more labels admit rarer words; of the entries that match at one place the heaviest counts. Exception phrases
(`trash can`) are entries of the same automaton that cancel the matches they cover. The score is a logistic function of
the matched weight, the weight per word, and the number of distinct entries, fitted on the same rows as the lexicon.

Lexicon and logistic are learned from the labelled ids whose fold is not held out, at most about `fit_rows` of them by
a hash of doc_id, one text of each; of a text beyond `fit_chars` characters pieces from its beginning to its end are learned. Every whole
text is scored. A null or empty text scores as one without matches; a null label is ignored; a doc_id labelled twice counts as toxic
if any label says so; of entries that are equally heavy at one place the longer counts, then the first by code point; repeated rows score
alike; other columns are ignored, or passed through untouched under any name; an empty table gives no rows; without labels the built-in
words are the lexicon.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import excerpt, id_crc32, map_batches, rows_of, seeded, table

FIT_ROWS, FIT_CHARS, THRESHOLD, PREFIX, SUPPORT, CHANCE = 10_000, 16_000, 0.3, (3, 9), 4, 1e-8
EXCEPTIONS = ("trash can", "trash cans", "trash bin", "clown fish")
#: Known whatever the labels hold, at a weight of its own.
BUILT_IN = ("idiot", "moron", "scum", "loser", "stupid", "pathetic", "worthless", "disgusting")
BUILT_IN_WEIGHT = 4.0
_LIKE = dict(zip("авекмнорстухіјѕԁһԛԝғгпиьαβεηικνορτυχγ", "abekmhopctyxijsdhqwfrnubabehikvoptuxy", strict=True))
_SIGN = dict(zip("013457@$!|", "oieastasii", strict=True))
_INNER = re.compile(r"[013457@$!|]+(?=[^\W\d_])")


class _Fold(dict):
    """Code point to folded text, filled as characters come."""

    def __missing__(self, code: int) -> str:
        c = unicodedata.normalize("NFKD", chr(code)).casefold()
        c = "".join(_LIKE.get(x, x) for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        out = "".join(x if x.isalpha() else " " for x in c)
        if not out and unicodedata.category(chr(code)) not in ("Mn", "Me", "Cf"):
            out = " "
        self[code] = out
        return out


_FOLD = _Fold()


def fold(text: str | None) -> str:
    """Folded words, a space before and behind; a run of signs right before a letter is read as letters."""
    if not text:
        return "  "
    if re.search(r"[013457@$!|]", text):
        text = _INNER.sub(lambda m: "".join(_SIGN[c] for c in m[0]), text)
    return f" {text.translate(_FOLD)} "


class Lexicon:
    """Weighted entries (" word " or " beginning"), exceptions and the logistic on top."""

    def __init__(self, weights: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS, beta: list[float] | None = None) -> None:
        import ahocorasick

        self.beta = beta or [-4.0, 0.5, 0.5, 0.5]
        self.automaton = ahocorasick.Automaton()
        for k, w in weights.items():
            self.automaton.add_word(k, (k, w))
        for phrase in exceptions:
            folded = f" {' '.join(fold(phrase).split())} "
            self.automaton.add_word(folded, (folded, 0.0))
        self.weights = weights
        if len(self.automaton):
            self.automaton.make_automaton()

    def features(self, text: str | None) -> list[float]:
        body = fold(text)
        best: dict[int, tuple[float, str]] = {}  # by where an entry begins; at its end the longer ones come first
        covered: list[tuple[int, int]] = []
        if len(self.automaton):
            for end, (entry, w) in self.automaton.iter(body):
                start = end - len(entry) + 1
                if w == 0.0:
                    covered.append((start, end))
                elif start not in best or (w, len(entry)) > (best[start][0], len(best[start][1])):
                    best[start] = (w, entry)
        if covered and best:
            reach, last = {}, -1  # exceptions may overlap: the last end of those that begin up to a place
            for s, e in sorted(covered):
                last = max(last, e)
                reach[s] = last
            starts_at, ends = np.array(list(reach)), np.array(list(reach.values()))
            at = np.array(list(best))
            i = np.searchsorted(starts_at, at, "right") - 1
            best = {s: best[s] for s, k in zip(at.tolist(), i.tolist(), strict=True) if k < 0 or ends[k] <= s}
        if not best:
            return [1.0, 0.0, 0.0, 0.0]
        total = sum(w for w, _ in best.values())
        words = max(1, len(body.split()))
        kinds = {entry for _, entry in best.values()}
        return [1.0, float(np.log1p(total)), float(np.sqrt(100 * total / words)), float(np.log1p(len(kinds)))]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ np.array(self.beta), -30, 30)))


def surprise(n: float, of: float, base: float) -> float:
    """Chernoff's bound for n or more toxic rows of `of` at a share of `base`, as minus its logarithm."""
    share = n / of
    if share <= base:
        return 0.0
    return of * (share * np.log(share / base) + (0.0 if n == of else (1 - share) * np.log((1 - share) / (1 - base))))


def learn(texts: list[str], toxic: list[int], exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """Entries whose odds of toxicity stand out, then the logistic by Newton steps."""
    built_in = {f" {w} ": BUILT_IN_WEIGHT for w in BUILT_IN}
    pos = sum(toxic)
    neg = len(toxic) - pos
    if not pos or not neg:
        return Lexicon(built_in, exceptions)
    seen = (Counter(), Counter())
    low, high = PREFIX
    for text, y in zip(texts, toxic, strict=True):
        own = set()
        for w in set(fold(text).split()):
            own.add(f" {w} ")
            for k in range(low, min(len(w), high) + 1):
                own.add(" " + w[:k])
        seen[int(y)].update(own)
    weights = dict(built_in)
    candidates = {k: n for k, n in seen[1].items() if n >= SUPPORT}
    bound = float(np.log(max(1, len(candidates)) / CHANCE))
    for k, n in candidates.items():
        w = float(np.log((n + 0.5) / (pos + 1)) - np.log((seen[0][k] + 0.5) / (neg + 1)))
        if w > 2.5 and n >= SUPPORT + 0.02 * seen[0][k] and surprise(n, n + seen[0][k], pos / (pos + neg)) > bound:
            weights[k] = w
    # an entry says nothing beside a shorter one that is as heavy
    weights = {k: w for k, w in weights.items() if not any(weights.get(k[:j], 0.0) >= w for j in range(1 + low, len(k)))}
    lexicon = Lexicon(weights, exceptions)
    x, y = np.array([lexicon.features(t) for t in texts]), np.array(toxic, float)
    beta, ridge = np.zeros(4), np.diag([1e-3, 0.1, 0.1, 0.1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (y - p) - ridge @ beta)
        beta += step
        if np.abs(step).max() < 1e-6:
            break
    lexicon.beta = beta.tolist()
    return lexicon


def labelled(docs: DataFrame, labels: DataFrame, what: str, folds: int, held: int, fit_rows: int, fit_chars: int) -> tuple[list[str], list[int]]:
    """Texts and labels of a bounded sample of the labelled ids that are not held out, one text of each id."""
    rows = labels.filter(F.col(what).isNotNull() & F.col("doc_id").isNotNull() & (id_crc32() % folds != held)).groupBy("doc_id").agg(F.max(what).alias("y"))
    n = rows.count()
    if not n:
        return [], []
    # the hash draws on both sides before they meet
    mine = seeded(what, "doc_id") < fit_rows / n
    texts = docs.filter(mine & F.col("text").isNotNull()).select("doc_id", excerpt(F.col("text"), fit_chars).alias("text"))
    one = texts.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    got = sorted((r.doc_id, r.text, int(r.y)) for r in one.join(rows.filter(mine), "doc_id").collect())
    return [t for _, t, _ in got], [y for _, _, y in got]


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, fit_chars: int = FIT_CHARS) -> Lexicon:
    return learn(*labelled(docs, labels, "toxic", 4, 2, fit_rows, fit_chars))


def score_toxicity(docs: DataFrame, lexicon: Lexicon, keep: list[Column] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """docs with score and predicted; keep: columns to pass through instead of doc_id and held_out."""
    weights, beta = dict(lexicon.weights), list(lexicon.beta)
    shared = docs.sparkSession.sparkContext.broadcast((weights, beta))  # bounded by the sample

    def make():
        own = Lexicon(*[shared.value[0], EXCEPTIONS, shared.value[1]])

        def run(batch: pa.RecordBatch) -> dict:
            score = own.score(np.array([own.features(t) for t in rows_of(batch, "_text")]))
            return {c: batch.column(i) for i, c in enumerate(batch.schema.names) if c != "_text"} | {"score": score, "predicted": (score >= threshold).astype(np.int32)}

        return run

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (id_crc32() % 4 == 2).alias("held_out"), F.col("text").alias("_text")) if keep is None else docs.select(*keep, F.col("text").alias("_text"))
    more = T._parse_datatype_string("score double, predicted int")
    return map_batches(base, make, T.StructType([*base.drop("_text").schema.fields, *more.fields]))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit(docs, table(spark, sf_dir, "labels")))
