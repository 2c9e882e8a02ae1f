"""The raw query language: +must -not should; AND, OR, NOT and parentheses; "phrases"; prefix*.

Parsing happens on the driver; a query becomes a Column over a token array, and a list of scoring terms.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import TextPolicy, bind, normalize_tokens, normalizer, phrase_at, split_words, tokenize

MAX_TOKENS, MAX_DEPTH = 1024, 128


class QueryError(ValueError):
    """The query text is not well formed."""


@dataclass(frozen=True)
class Leaf:
    kind: str  # term, prefix or phrase
    words: tuple[str, ...]


@dataclass(frozen=True)
class Op:
    kind: str  # and, or, not
    parts: tuple = ()


@dataclass(frozen=True)
class Query:
    root: Leaf | Op | None
    leaves: tuple[Leaf, ...] = ()  # scoring leaves, in order, repeats kept
    simple: bool = True  # documents without a match fill up the result with score 0
    text: str = ""

    @property
    def terms(self) -> list[str]:
        return [w for x in self.leaves if x.kind != "prefix" for w in x.words]

    @property
    def prefixes(self) -> list[str]:
        return [x.words[0] for x in self.leaves if x.kind == "prefix"]

    @property
    def phrases(self) -> list[list[str]]:
        return [list(x.words) for x in self.leaves if x.kind == "phrase"]


@dataclass
class _Reader:
    tokens: list[tuple[str, str | tuple[str, ...]]]
    at: int = 0
    depth: int = 0
    seen: list = field(default_factory=list)

    def peek(self) -> str:
        return self.tokens[self.at][0] if self.at < len(self.tokens) else "end"


def lex(text: str) -> list[tuple[str, str | tuple[str, ...]]]:
    """(kind, value): + - ( ) and or not term prefix phrase."""
    out: list[tuple[str, str | tuple[str, ...]]] = []
    i, n = 0, len(text)
    while i < n:
        c = text[i]
        if c.isspace():
            i += 1
        elif c in "()+-":
            out.append((c, c))
            i += 1
        elif c == '"':
            end = text.find('"', i + 1)
            words = tuple(text[i + 1 : end].split()) if end > 0 else ()
            if end < 0:
                raise QueryError("a quote is not closed")
            if not words:
                raise QueryError("a phrase is empty")
            out.append(("phrase", words))
            i = end + 1
        else:
            j = i
            while j < n and not text[j].isspace() and text[j] not in "()":
                j += 1
            word = text[i:j]
            i = j
            if word in ("AND", "OR", "NOT"):
                out.append((word.lower(), word))
            elif word.endswith("*"):
                if not word.rstrip("*"):
                    raise QueryError("a prefix is empty")
                out.append(("prefix", word[:-1]))
            else:
                out.append(("term", word))
        if len(out) > MAX_TOKENS:
            raise QueryError(f"more than {MAX_TOKENS} tokens")
    return out


def parse(text: str, normalize: Callable[[str], list[str]] | None = None) -> Query:
    """normalize: a token to the tokens that the index's text policy makes of it (none: the leaf falls away)."""
    tokens = lex(text)

    def leaf(kind: str, value) -> Leaf | None:
        words = value if isinstance(value, tuple) else (value,)
        if normalize:
            words = tuple(w for x in words for w in normalize(x))
        if not words:
            return None
        return Leaf("term" if kind == "phrase" and len(words) == 1 else kind, words) if kind != "term" or len(words) == 1 else Leaf("phrase", words)

    if any(k in ("(", ")", "and", "or", "not") for k, _ in tokens):
        return _boolean(text, tokens, leaf)
    must, must_not, should, scored = [], [], [], []
    sign = ""
    for kind, value in tokens:
        if kind in "+-":
            if sign:
                raise QueryError("two signs in a row")
            sign = kind
            continue
        x = leaf(kind, value)
        if x is not None:
            (must if sign == "+" else must_not if sign == "-" else should).append(x)
            if sign != "-":
                scored.append(x)
        sign = ""
    if sign:
        raise QueryError("a sign has no term")
    parts = [*must] or ([Op("or", tuple(should))] if should else [])
    parts += [Op("not", (x,)) for x in must_not]
    root = None if not parts else parts[0] if len(parts) == 1 else Op("and", tuple(parts))
    simple = not must and not must_not and all(x.kind in ("term", "prefix") for x in should)
    return Query(root, tuple(scored), simple, text)


def _boolean(text: str, tokens: list, leaf) -> Query:
    r = _Reader(tokens)

    def any_of():
        parts = [all_of()]
        while r.peek() not in ("end", ")"):
            if r.peek() == "or":
                r.at += 1
            parts.append(all_of())
        parts = [p for p in parts if p is not None]
        return parts[0] if len(parts) == 1 else Op("or", tuple(parts)) if parts else None

    def all_of():
        parts = [one()]
        while r.peek() == "and":
            r.at += 1
            parts.append(one())
        parts = [p for p in parts if p is not None]
        return parts[0] if len(parts) == 1 else Op("and", tuple(parts)) if parts else None

    def one():
        kind = r.peek()
        if kind in ("end", ")", "and", "or"):
            raise QueryError("a term is missing")
        value = r.tokens[r.at][1]
        r.at += 1
        if kind in ("term", "prefix", "phrase"):
            x = leaf(kind, value)
            if x is not None:
                r.seen.append(x)
            return x
        r.depth += 1  # of parentheses and signs; a leaf is no level
        if r.depth > MAX_DEPTH:
            raise QueryError("nested too deeply")
        try:
            if kind == "+":
                return one()
            if kind in ("not", "-"):
                kept = len(r.seen)
                x = one()
                del r.seen[kept:]
                return None if x is None else Op("not", (x,))
            x = any_of()
            if r.peek() != ")":
                raise QueryError("a parenthesis is not closed")
            r.at += 1
            return x
        finally:
            r.depth -= 1

    root = any_of()
    if r.peek() != "end":
        raise QueryError("a parenthesis is not open")

    def ors(x) -> bool:
        return x.kind == "term" if isinstance(x, Leaf) else x.kind == "or" and all(map(ors, x.parts))

    return Query(root, tuple(r.seen), root is None or ors(root), text)


def leaves_of(root: Leaf | Op | None) -> list[Leaf]:
    """All leaves, those under a NOT included, each once."""
    if root is None:
        return []
    if isinstance(root, Leaf):
        return [root]
    return list(dict.fromkeys(x for p in root.parts for x in leaves_of(p)))


def truth(root: Leaf | Op | None, of: Callable[[Leaf], Column]) -> Column:
    """The query as a Column over what `of` says of each leaf."""
    if root is None:
        return F.lit(False)
    if isinstance(root, Leaf):
        return of(root)
    parts = [truth(p, of) for p in root.parts]
    return ~parts[0] if root.kind == "not" else reduce(Column.__and__ if root.kind == "and" else Column.__or__, parts)


def holds_of_nothing(root: Leaf | Op | None) -> bool:
    """Whether rows that no leaf matches answer the query."""
    if root is None or isinstance(root, Leaf):
        return False
    parts = [holds_of_nothing(p) for p in root.parts]
    return not parts[0] if root.kind == "not" else all(parts) if root.kind == "and" else any(parts)


def match(root: Leaf | Op | None, tokens: Column) -> Column:
    """Whether a token array satisfies the query; the tokens are computed once."""

    def leaf(t: Column) -> Callable[[Leaf], Column]:
        def one(x: Leaf) -> Column:
            if x.kind == "prefix":
                return F.exists(t, lambda w: w.startswith(x.words[0]))
            if x.kind == "phrase":
                return F.array_contains(t, x.words[0]) & (F.size(phrase_at(t, list(x.words))) > 0)
            return F.array_contains(t, x.words[0])

        return one

    none = F.array().cast("array<string>")
    return bind(F.coalesce(tokens, none), lambda t: truth(root, leaf(t)))


@dataclass(frozen=True)
class Prepared:
    """A query with text options of its own; what is None is taken from the index's policy when it is resolved."""

    text: str
    lowercase: bool | None = None
    stopwords: tuple[str, ...] | None = None
    stem_english: bool | None = None
    fold_diacritics: bool | None = None

    def resolve(self, policy: TextPolicy | None = None) -> TextPolicy:
        base = policy or TextPolicy()
        own = {k: v for k in ("lowercase", "stopwords", "stem_english", "fold_diacritics") if (v := getattr(self, k)) is not None}
        return replace(base, **own)

    def parsed(self, policy: TextPolicy | None = None) -> Query:
        return parse(self.text, normalizer(self.resolve(policy)))

    def order_tokens(self, policy: TextPolicy | None = None) -> list[str]:
        """The query's text as the tokens that rows are ordered by, no operator being read."""
        clean = normalizer(self.resolve(policy))
        return [t for w in split_words(self.text) for t in clean(w)]


def match_query(df: DataFrame, column: str, query: str | Prepared, policy: TextPolicy | None = None) -> Column:
    """Whether rows answer a query: a text column is tokenised by the query's resolved policy first, a token column is normalised by it."""
    prepared = query if isinstance(query, Prepared) else None
    kind = df.schema[column].dataType
    if prepared is None:
        if isinstance(kind, T.ArrayType):
            return match(parse(query).root, F.col(column).cast("array<string>"))
        prepared = Prepared(query)
    own = prepared.resolve(policy)
    if isinstance(kind, T.ArrayType):
        tokens = normalize_tokens(F.col(column).cast("array<string>"), own)
    elif isinstance(kind, T.StringType):
        tokens = tokenize(F.col(column), own)
    else:
        raise QueryError("a query is matched against one text or token column")
    return match(prepared.parsed(policy).root, tokens)
