"""Column builders for text: tokens, normalisation, highlighting, snippets. All but stemming stay inside the JVM."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .porter import stem

#: Letters, digits, marks and underscores.
SIMPLE = r"[\p{L}\p{N}_]+"
#: Word breaks close to UAX #29: apostrophes, dots and colons join letters, commas and dots join digits, an ideograph stands alone.
WORDS = r"[\p{IsHan}\p{IsHiragana}]\p{M}*|[\p{L}\p{N}\p{M}_&&[^\p{IsHan}\p{IsHiragana}]]+(?:(?:(?<=\p{L})['’.:·](?=\p{L})|(?<=\p{N})[.,;'](?=\p{N}))[\p{L}\p{N}\p{M}_&&[^\p{IsHan}\p{IsHiragana}]]+)*"


def bind(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c) with c computed once: the optimiser copies a column into each place that names it, but not what a lambda has bound."""
    return F.get(F.transform(F.array(c), f), 0)


@dataclass(frozen=True)
class TextPolicy:
    """How tokens are normalised; None means the index's own setting where a query overrides one."""

    lowercase: bool = True
    stopwords: tuple[str, ...] = ()
    stem_english: bool = False
    fold_diacritics: bool = False

    @staticmethod
    def stopword_list(text: str) -> tuple[str, ...]:
        return tuple(x for x in (w.strip() for w in text.split(",")) if x)


def nfc(c: Column) -> Column:
    """Canonical composition by the ICU library that Spark ships; ASCII, the common case, is left alone."""
    return F.when(c.rlike(r"[^\x00-\x7F]"), F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(False))).otherwise(c)


def case_fold(c: Column) -> Column:
    return F.when(c.rlike(r"[^\x00-\x7F]"), F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), c, F.lit(True))).otherwise(F.lower(c))


def fold_diacritics(c: Column) -> Column:
    bare = F.regexp_replace(F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("decompose"), c, F.lit(False)), r"\p{M}+", "")
    return F.when(c.rlike(r"[^\x00-\x7F]"), nfc(bare)).otherwise(c)


def normalizer(policy: TextPolicy | None = None) -> Callable[[str], list[str]]:
    """The same normalisation for a query's tokens, on the driver: none is left of a stopword."""
    policy = policy or TextPolicy()

    def one(token: str) -> list[str]:
        t = unicodedata.normalize("NFC", token)
        if policy.lowercase or policy.stem_english:
            t = t.casefold()
        if policy.fold_diacritics:
            t = unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c)[0] != "M"))
        if not t or t in policy.stopwords:
            return []
        return [stem(t) if policy.stem_english else t]

    return one


@functools.cache
def _stemmer():
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def stem_tokens(tokens: pd.Series) -> pd.Series:
        return tokens.map(lambda ts: None if ts is None else [t and stem(t) for t in ts])

    return stem_tokens


def stem_tokens(tokens: Column) -> Column:
    return _stemmer()(tokens)


def split_words(text: str) -> list[str]:
    """Words of a short text on the driver, by the breaks of WORDS."""
    import regex

    han = r"[\p{Han}\p{Hiragana}]\p{M}*"
    join = r"(?<=\p{L})['’.:·](?=\p{L})|(?<=\p{N})[.,;'](?=\p{N})"
    word = r"[[\p{L}\p{N}\p{M}_]--[\p{Han}\p{Hiragana}]]+"
    return regex.findall(rf"(?V1){han}|{word}(?:(?:{join}){word})*", text)


def simple_tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores; a null text has none."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(SIMPLE), F.lit(0)), F.array().cast("array<string>"))


def tokenize(text: Column, policy: TextPolicy | None = None) -> Column:
    """NFC, word breaks, then the policy; order and repeats are kept."""
    policy = policy or TextPolicy()
    clean = nfc(text)
    if policy.lowercase or policy.stem_english:
        clean = case_fold(clean)
    if policy.fold_diacritics:
        clean = fold_diacritics(clean)
    tokens = F.coalesce(F.regexp_extract_all(clean, F.lit(WORDS), F.lit(0)), F.array().cast("array<string>"))
    return _finish(tokens, policy)


def _finish(tokens: Column, policy: TextPolicy) -> Column:
    if policy.stopwords:
        tokens = F.filter(tokens, lambda t: ~t.isin(*policy.stopwords))
    return stem_tokens(tokens) if policy.stem_english else tokens


def normalize_tokens(tokens: Column, policy: TextPolicy | None = None) -> Column:
    """Tokens that are there already, normalised one by one; those emptied or stopped are dropped."""
    policy = policy or TextPolicy()

    # all tokens are folded as one text: reflective calls need a column, not a lambda's variable
    joined = F.array_join(tokens, "\x1f")
    clean = nfc(joined)
    if policy.lowercase or policy.stem_english:
        clean = case_fold(clean)
    if policy.fold_diacritics:
        clean = fold_diacritics(clean)
    return _finish(F.filter(F.split(clean, "\x1f"), lambda t: t != ""), policy)


def phrase_at(tokens: Column, phrase: list[str]) -> Column:
    """Start positions (from 1) of a phrase; tokens are named more than once, so bind() what is computed."""
    n = len(phrase)
    want = F.array(*[F.lit(p) for p in phrase])
    starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.greatest(F.size(tokens) - n + 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.filter(starts, lambda i: (F.element_at(tokens, i) == phrase[0]) & (F.slice(tokens, i, n) == want))


def overlap(tokens: Column, query: list[str]) -> Column:
    """How many query elements, repeats counted, the tokens hold."""
    total = F.lit(0)
    for q in query:
        total = total + F.coalesce(F.array_contains(tokens, q), F.lit(False)).cast("int")
    return total


def overlap_distance(tokens: Column, query: list[str]) -> Column:
    return -overlap(tokens, query).cast("double")


def marks(tokens: Column, terms: list[str], prefixes: list[str], phrases: list[list[str]]) -> Column:
    """For each token whether a term, a prefix or a phrase that it stands in matches."""
    spans = [(phrase_at(tokens, p), len(p)) for p in phrases]

    def inside(starts: Column, i: Column, n: int) -> Column:
        return F.exists(starts, lambda s: (i + 1 >= s) & (i + 1 < s + n))

    def hit(t: Column, i: Column) -> Column:
        found = t.isin(*terms) if terms else F.lit(False)
        for p in prefixes:
            found = found | t.startswith(p)
        for starts, n in spans:
            found = found | inside(starts, i, n)
        return found

    return F.transform(tokens, hit)


def highlight(tokens: Column, terms: list[str], prefixes: list[str] | None = None, phrases: list[list[str]] | None = None, start: str = "<b>", end: str = "</b>") -> Column:
    """Tokens joined by one space, matches wrapped."""

    def whole(t: Column) -> Column:
        return F.array_join(_wrapped(t, marks(t, terms, prefixes or [], phrases or []), start, end), " ")

    return bind(tokens, whole)


def _wrapped(tokens: Column, flags: Column, start: str, end: str) -> Column:
    return F.zip_with(tokens, flags, lambda t, m: F.when(m, F.concat(F.lit(start), t, F.lit(end))).otherwise(t))


def snippet(tokens: Column, terms: list[str], prefixes: list[str] | None = None, phrases: list[list[str]] | None = None, max_tokens: int = 24, start: str = "<b>", end: str = "</b>") -> Column:
    """A window of max_tokens around the first match, half of it before, with ellipses where text is left out."""

    def window(t: Column) -> Column:
        return bind(marks(t, terms, prefixes or [], phrases or []), lambda flags: cut(t, flags))

    def cut(t: Column, flags: Column) -> Column:
        first = F.greatest(F.array_position(flags, True).cast("int"), F.lit(1))
        at = F.greatest(F.lit(1), F.least(first - max_tokens // 2, F.size(t) - max_tokens + 1))
        body = F.array_join(F.slice(_wrapped(t, flags, start, end), at, max_tokens), " ")
        return F.concat(F.when(at > 1, "... ").otherwise(""), body, F.when(at + max_tokens <= F.size(t), " ...").otherwise(""))

    return bind(tokens, window)


def plain_terms(text: Column) -> Column:
    """User text as terms only, joined by spaces, so that no operator reaches the parser; null where the text has no terms."""
    words = F.array_join(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), " ")
    return F.when(words != "", words)
