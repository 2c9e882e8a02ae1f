"""A persistent inverted index: versioned Parquet tables under one folder, and numbered manifests of which the last one counts.

Tables of a version: `postings` (term, key, tf, _dl, pos), in `bucket` partitions by term hash and sorted by term, so that a query reads a few
row groups; `terms` (term, df, cf, max_tf, min_dl), sorted; `docs`, the source rows with _dl, with a Bloom filter on the key. Buckets and
slices of a bucket grow with the tokens, so a write task holds about as many postings at any size; a hot term lies in all slices of its bucket.
Postings travel packed (postings.py), and the files are compressed by zstd.

Changes are written to `log/<name>` and then committed: the commit takes the next number, of which only one writer can have each, and names the
folder. A version has folded all commits up to a number. Numbers are given at commit and have no gaps, so a change that is committed
late is later than every fold that did not read it. Under realtime and eventual consistency a query reads the version with the
commits behind it applied, its statistics included; under manual consistency they wait for maintain(), which folds them into the next version.

A query is answered from postings: gains are summed by key, a boolean query is a Column over which of its leaves each key has, phrases are
matched by positions, and only the k best keys are looked up in `docs`. An index over several columns is one token stream, or,
field-aware, a name space of its own for each column under the combined length.
"""

from __future__ import annotations

import json
import math
import time
import uuid
import zlib
from collections import Counter
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import TextPolicy, normalize_tokens, normalizer, tokenize
from ..plans.querylang import Leaf, Prepared, Query, QueryError, holds_of_nothing, leaves_of, parse, truth
from ..streaming import mutation
from . import batch, postings
from .fields import fused
from .filters import equalities, predicate
from .options import check_options
from .scoring import Bm25, score_batch
from .store import Store

#: Tokens of a bucket before there is another, buckets at most, tokens of a slice; changes that make a fold due; keys a query may hold on the driver.
BUCKET_TOKENS, MAX_BUCKETS, SLICE_TOKENS, FOLD_AT, HELD = 250_000, 64, 2_000_000, 65_536, 10_000
CONSISTENCY = ("realtime", "eventual", "manual")
#: Seconds before what no commit names may be deleted, and before a reader or a lock that was not released is given up.
GRACE, LEASE = 86_400, 3600
#: Of the tables of a version.
CODEC = "zstd"
#: Stands between a field's name and a term in field-aware postings.
SEP = "\x1f"


@dataclass(frozen=True)
class View:
    """What a query sees: the version's docs, the keys changed since, their new rows, and the statistics of both together."""

    docs: DataFrame
    changed: DataFrame | None
    new: DataFrame | None
    n: float
    length: float

    @property
    def rows(self) -> DataFrame:
        return self.docs if self.changed is None else self.docs.join(self.changed, self.changed.columns[0], "left_anti").unionByName(self.new)


def _prefixed(tokens: Column, field: str) -> Column:
    return F.transform(tokens, lambda t: F.concat(F.lit(field + SEP), t))


def _any(tests: list[Column]) -> Column:
    return reduce(Column.__or__, tests) if tests else F.lit(False)


def _among(c: Column, values: list) -> Column:
    """Membership in lists short enough for Parquet's filters to see each value."""
    return _any([c.isin(*values[i : i + 10]) for i in range(0, len(values), 10)])


class Index:
    """Build, query, change, maintain."""

    def __init__(self, spark: SparkSession, path: str, manifest: dict) -> None:
        self.spark, self.path, self.manifest, self.store = spark, path.rstrip("/"), manifest, Store(spark, path)
        self._reader: str | None = None

    @classmethod
    def open(cls, spark: SparkSession, path: str, pin: bool = False) -> Index:
        """The last version; pin: registered as a reader, so that reclaim() leaves the version until close() or the lease ends."""
        store = Store(spark, path)
        index = cls(spark, path, store.read(f"_manifests/{store.names('_manifests')[-1]}"))
        return index.pin() if pin else index

    @classmethod
    def build(
        cls,
        spark: SparkSession,
        path: str,
        source: DataFrame,
        key: str,
        tokens: Column | str | list[str] | None = None,
        *,
        expression: str | None = None,
        where: str | None = None,
        scope: list[str] | None = None,
        params: Bm25 | None = None,
        policy: TextPolicy | None = None,
        consistency: str = "realtime",
        field_aware: bool = False,
        buckets: int | None = None,
        create_empty_token: bool = True,
        options: dict | None = None,
        generation: int = 1,
        folded: int = 0,
        streams: dict | None = None,
    ) -> Index:
        """tokens: text or token columns by name, or a Column over the source. A policy holds for text, and for tokens where one is given.

        expression: SQL for the text or tokens instead, which the index remembers, so that it can be changed. where: SQL; rows that do not
        fulfil it are not part of the index. scope: columns that filters are answered for from postings of their values.
        create_empty_token: a query none of whose tokens is known ranks every row at the base score; without, it is an error."""
        if consistency not in CONSISTENCY:
            raise ValueError(f"consistency is one of {CONSISTENCY}")
        check_options(options or {}, consistency=consistency, params=params, policy=policy)
        if (tokens is None) == (expression is None):
            raise ValueError("an index is over tokens or over an expression")
        names = None if expression or isinstance(tokens, Column) else [tokens] if isinstance(tokens, str) else list(tokens)
        if field_aware and not names:
            raise ValueError("a field-aware index is built over named columns")
        p = params or Bm25()
        version = f"{path.rstrip('/')}/v={generation}-{uuid.uuid4().hex[:8]}"
        manifest = {"version": version, "generation": generation, "rebuilds": generation - 1, "folded": folded, "key": key, "columns": names, "expression": expression, "where": where}
        manifest |= {"scope": list(scope or []), "field_aware": field_aware, "consistency": consistency, "create_empty_token": create_empty_token, "options": options or {}, "streams": streams or {}}
        manifest |= {"params": {"method": p.method, "idf_method": p.idf_method, "k1": p.k1, "b": p.b, "delta": p.delta}, "policy": None if policy is None else vars(policy)}
        index = cls(spark, path, manifest)
        of = index._tokens(source) if names or expression else tokens
        source = source.filter(where) if where else source
        sized = source.withColumn("_dl", F.size(F.coalesce(of, F.array().cast("array<string>"))).cast("double"))
        sized.write.option(f"parquet.bloom.filter.enabled#{key}", "true").option("compression", CODEC).parquet(f"{version}/docs")
        total = index.table("docs").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("_dl"), F.lit(0.0)).alias("len")).first()
        buckets = buckets or max(1, min(MAX_BUCKETS, math.ceil(total.len / BUCKET_TOKENS)))
        slices = max(1, math.ceil(total.len / (buckets * SLICE_TOKENS)))
        index.manifest |= {"docs": total.n, "total_length": total.len, "buckets": buckets, "slices": slices, "built": time.time()}
        index._write_postings(of, buckets, slices)
        if scope:
            index._write_scope(scope)
        if not Store(spark, path).create(f"_manifests/{generation:012d}.json", index.manifest):
            index.store.delete(version.rsplit("/", 1)[1])
            raise OSError(f"generation {generation} has been published already")
        return index

    def _write_postings(self, tokens: Column, buckets: int, slices: int) -> None:
        """One shuffle, to a task for each (bucket, slice of the key): never two of them in a task. What arrives is in order and stays so, as the writer's sort by bucket has one value to sort."""
        version, key = self.manifest["version"], self.manifest["key"]
        rows = postings.write_order(self.table("docs"), key, tokens, buckets, slices)
        rows.write.partitionBy("bucket").option("compression", CODEC).parquet(f"{version}/postings")
        kind = T.StructType([*rows.drop("bucket").schema.fields, T.StructField("bucket", T.IntegerType())])
        self.manifest["postings"] = kind.jsonValue()
        terms = self.table("postings").groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"), F.max("tf").alias("max_tf"), F.min("_dl").alias("min_dl"))
        terms.sortWithinPartitions("term").write.option("compression", CODEC).parquet(f"{version}/terms")

    def _write_scope(self, columns: list[str]) -> None:
        """(col, value, key) sorted by value: which rows have a value; of an array, each of its elements."""
        docs, key = self.table("docs"), self.manifest["key"]
        parts = []
        for c in columns:
            values = F.array_distinct(F.col(c).cast("array<string>")) if isinstance(docs.schema[c].dataType, T.ArrayType) else F.array(F.col(c).cast("string"))
            parts.append(docs.select(key, F.lit(c).alias("col"), F.explode(values).alias("value")))
        rows = reduce(DataFrame.unionByName, parts).filter("value IS NOT NULL")
        spread = max(1, math.ceil(self.manifest["docs"] / SLICE_TOKENS))
        dealt = rows.repartition("col", "value", F.pmod(F.xxhash64(key), F.lit(spread))).sortWithinPartitions("col", "value", key)
        dealt.write.partitionBy("col").parquet(f"{self.manifest['version']}/scope")

    def drop(self) -> None:
        self.store.delete()

    # ---- what the manifest says

    @property
    def params(self) -> Bm25:
        return Bm25(**self.manifest["params"])

    @property
    def policy(self) -> TextPolicy | None:
        p = self.manifest["policy"]
        return None if p is None else TextPolicy(**{k: tuple(v) if isinstance(v, (list, tuple)) else v for k, v in p.items()})

    def table(self, name: str) -> DataFrame:
        at = f"{self.manifest['version']}/{name}"
        if name == "postings":
            return self.spark.read.schema(T.StructType.fromJson(self.manifest["postings"])).parquet(at)
        return self.spark.read.parquet(at)

    def _tokens(self, docs: DataFrame) -> Column:
        """The token stream of docs by the index's own columns or expression."""
        m, none = self.manifest, F.array().cast("array<string>")
        if m["expression"]:
            kind = docs.select(F.expr(m["expression"]).alias("x")).schema["x"].dataType
            return F.coalesce(self._part(F.expr(m["expression"]), kind), none)
        if not m["columns"]:
            raise ValueError("an index over a Column needs its tokens; give an SQL expression, which an index remembers")
        parts = [F.coalesce(self._part(F.col(f"`{c}`"), docs.schema[c].dataType), none) for c in m["columns"]]
        return fused(*[_prefixed(p, c) for p, c in zip(parts, m["columns"], strict=True)] if m["field_aware"] else parts)

    def _part(self, c: Column, kind: T.DataType) -> Column:
        if not isinstance(kind, T.ArrayType):
            return tokenize(c.cast("string"), self.policy)
        words = c.cast("array<string>")
        return words if self.policy is None else normalize_tokens(words, self.policy)

    def _normalize(self):
        """What queries are normalised with: nothing where the index holds tokens as they came."""
        m = self.manifest
        text = self.policy is not None
        if not text and (m["columns"] or m["expression"]):
            docs = self.table("docs")
            kinds = [docs.schema[c].dataType for c in m["columns"]] if m["columns"] else [docs.select(F.expr(m["expression"]).alias("x")).schema["x"].dataType]
            text = any(not isinstance(k, T.ArrayType) for k in kinds)
        return normalizer(self.policy) if text else None

    def _words(self, docs: DataFrame, tokens: Column) -> DataFrame:
        return docs.select(self.manifest["key"], "_dl", F.posexplode(tokens).alias("_p", "term"))

    def _counted(self, words: DataFrame, *by: str) -> DataFrame:
        key = self.manifest["key"]
        got = words.groupBy(*by, "term", key, "_dl").agg(F.count(F.lit(1)).cast("int").alias("tf"), F.array_sort(F.collect_list("_p")).alias("pos"))
        return got.select("term", key, "tf", "_dl", "pos", *by)

    # ---- the version with the commits behind it applied

    def _commits(self) -> list[dict]:
        """Commits that this version has not folded, in order."""
        return [{"n": n} | self.store.read(f"_commits/{name}") for name in self.store.names("_commits") if (n := int(name.split(".")[0])) > self.manifest["folded"]]

    def _fields(self) -> list[T.StructField]:
        return [f for f in self.table("docs").schema if f.name != "_dl"]

    def _log(self, commits: list[dict]) -> DataFrame:
        """The rows of the commits with their number, _n, and their order in it, _ord."""
        kind = T.StructType([*self._fields(), T.StructField("_op", T.StringType()), T.StructField("_ord", T.StringType()), T.StructField("u", T.StringType())])
        rows = self.spark.read.schema(kind).option("basePath", f"{self.path}/log").parquet(*[f"{self.path}/log/u={c['data']}" for c in commits])
        numbers = self.spark.createDataFrame([(c["data"], c["n"]) for c in commits], "u string, _n long")  # a row per commit
        return rows.join(numbers, "u").drop("u")

    def _latest(self, commits: list[dict]) -> DataFrame:
        return mutation.latest(self._log(commits), self.manifest["key"], "_n", "_ord")

    def _new(self, last: DataFrame) -> DataFrame:
        """Rows that the last changes put in; a row outside of the index's `where` is as good as deleted."""
        new = last.filter("_op = 'upsert'")
        return new.filter(self.manifest["where"]) if self.manifest["where"] else new

    def _view(self) -> View:
        m, key = self.manifest, self.manifest["key"]
        docs = self.table("docs")
        commits = [] if m["consistency"] == "manual" else self._commits()
        if not commits:
            return View(docs, None, None, float(m["docs"]), float(m["total_length"]))
        last = self._latest(commits)
        new = self._new(last)
        new = new.withColumn("_dl", F.size(self._tokens(new)).cast("double")).select(*docs.columns)
        keys = mutation.counted(last.select(key))
        gone = docs.join(keys, key, "left_semi").select(F.lit(-1).alias("s"), "_dl")
        by = gone.union(new.select(F.lit(1), "_dl")).agg(F.coalesce(F.sum("s"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("s") * F.col("_dl")), F.lit(0.0)).alias("len")).first()
        return View(docs, keys, new, float(m["docs"] + by.n), m["total_length"] + by.len)

    def _hits(self, terms: list[str], prefixes: list[str], view: View) -> DataFrame:
        """Postings of the terms and of all terms that a prefix begins: the store's filters see both."""
        key = self.manifest["key"]
        exact = F.col("term").isin(*terms) if terms else F.lit(False)
        begins = _any([F.col("term").startswith(p) for p in prefixes])
        buckets = sorted({zlib.crc32(t.encode("utf-8", "surrogatepass")) % self.manifest["buckets"] for t in terms})
        stored = self.table("postings").filter((F.col("bucket").isin(*buckets) & exact if terms else exact) | begins).drop("bucket")
        if view.changed is None:
            return stored
        new = self._counted(self._words(view.new, self._tokens(view.new))).filter(exact | begins)
        return stored.join(view.changed, key, "left_anti").unionByName(new)

    def _frequencies(self, hits: DataFrame, terms: list[str], prefixes: list[str], view: View) -> DataFrame:
        """(term, df) of the same terms: stored, or counted again where the log changes them."""
        if view.changed is not None:
            return hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        exact = F.col("term").isin(*terms) if terms else F.lit(False)
        return self.table("terms").filter(exact | _any([F.col("term").startswith(p) for p in prefixes])).select("term", "df")

    # ---- queries

    def query(self, text: str | Prepared, k: int = 10, filters: dict | str | None = None, allowed: DataFrame | None = None, mask: Column | None = None, digits: int = 6, normalize=None) -> DataFrame:
        """The k best source rows with `score` by the raw query language; ties go to the smaller key.

        filters and allowed keys restrict what is ranked, statistics stay those of the whole index. mask: a factor of each row's gain.
        text may be a Prepared query, whose own text options then hold."""
        if k is None or k < 1:
            raise ValueError("k is positive")
        q = text.parsed(self.policy) if isinstance(text, Prepared) else parse(text, normalize or self._normalize())
        words = Counter(q.terms)
        if self.manifest["field_aware"]:
            if not q.simple or q.prefixes or q.phrases:
                raise QueryError("a query over fields takes plain terms only")
            words = {c + SEP + t: float(n) for t, n in words.items() for c in self.manifest["columns"]}
        return self._answer(dict(words), q, k, filters, allowed, mask, digits)

    def query_tokens(self, terms: list[str], k: int = 10, filters: dict | str | None = None, allowed: DataFrame | None = None, mask: Column | None = None, digits: int = 6) -> DataFrame:
        """The k best rows for tokens as they are, repeats counted; rows without a match fill up at their base score."""
        if k is None or k < 1:
            raise ValueError("k is positive")
        return self._answer(dict(Counter(map(str, terms))), None, k, filters, allowed, mask, digits)

    query_ids = query_tokens

    def query_fields(self, text: str, weights: dict[str, float | None], k: int = 10, filters: dict | str | None = None, digits: int = 6) -> DataFrame:
        """The k best rows of a field-aware index, terms weighted by the field they stand in; a null weight is 1."""
        if k is None or k < 1:
            raise ValueError("k is positive")
        if not self.manifest["field_aware"] or not weights or set(weights) - set(self.manifest["columns"]):
            raise ValueError("weights are by the fields of a field-aware index")
        weights = {c: 1.0 if w is None else float(w) for c, w in weights.items()}
        if not all(math.isfinite(w) and w >= 0 for w in weights.values()):
            raise ValueError("field weights must be finite and not negative")
        q = parse(text, self._normalize())
        if not q.simple or q.prefixes or q.phrases:
            raise QueryError("a query over fields takes plain terms only")
        return self._answer({c + SEP + t: n * w for t, n in Counter(q.terms).items() for c, w in weights.items()}, None, k, filters, None, None, digits)

    def query_batch(self, queries: DataFrame, k: int, digits: int = 6) -> DataFrame:
        """queries (query_id, term), terms as the index holds them: (query_id, key, score, rank) of the k best that hold a term, from postings alone."""
        view, key = self._view(), self.manifest["key"]
        hits = self.table("postings").select("term", key, F.col("tf").cast("double").alias("tf"), F.col("_dl").alias("dl"))
        df = self.table("terms").select("term", "df")
        if view.changed is not None:
            new = self._counted(self._words(view.new, self._tokens(view.new))).select("term", key, F.col("tf").cast("double").alias("tf"), F.col("_dl").alias("dl"))
            hits = hits.join(view.changed, key, "left_anti").unionByName(new)
            df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        avgdl = view.length / view.n if view.n else 0.0
        asked = batch.Asked.of(queries, k)
        if asked is not None:
            parts = max(1, math.ceil(view.length / SLICE_TOKENS))
            return batch.from_postings(hits, key, df, asked, view.n, avgdl, self.params, k, digits, parts)
        terms = queries.select("term").distinct()
        df = df.select("term", F.col("df").cast("double").alias("df"), F.lit(view.n).alias("n"), F.lit(avgdl).alias("avgdl"))
        return score_batch(hits.join(terms, "term", "left_semi"), df, key, queries, self.params, k, digits)

    def match(self, text: str) -> DataFrame:
        """The keys of all rows that answer a query, unranked."""
        q, view = parse(text, self._normalize()), self._view()
        return self._gains({}, q, view)[0].select(self.manifest["key"])

    def evidence(self, text: str) -> DataFrame:
        """What a query looks at: for each term or begun term its df, postings, idf, weight and the highest score that any row can have from it."""
        q, view, p = parse(text, self._normalize()), self._view(), self.params
        words, m = dict(Counter(q.terms)), self.manifest
        terms = self.table("terms").filter((F.col("term").isin(*words) if words else F.lit(False)) | _any([F.col("term").startswith(x) for x in q.prefixes]))
        idf = p.idf(F.col("df").cast("double"), F.lit(float(m["docs"])))
        best = p.tfc(F.col("max_tf").cast("double"), F.col("min_dl"), F.lit(view.length / view.n if view.n else 0.0))
        weight = self._weight(words, q.prefixes)
        return terms.select("term", "df", "cf", weight.alias("weight"), F.round(idf, 6).alias("idf"), F.round(idf * weight * best, 6).alias("bound"))

    def _weight(self, words: dict[str, float], prefixes: list[str]) -> Column:
        w = F.lit(0.0)
        if words:
            w = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for t, n in words.items() for x in (t, float(n))]), F.col("term")), w)
        for p in prefixes:
            w = w + F.when(F.col("term").startswith(p), 1.0).otherwise(0.0)
        return w

    def _gains(self, words: dict[str, float], q: Query | None, view: View) -> tuple[DataFrame, float]:
        """((key, _gain) of the keys that answer the query, or hold one of its terms where all rows do; the score of a key without any)."""
        key, p = self.manifest["key"], self.params
        ask = None if q is None or q.simple else q.root
        prefixes = q.prefixes if q else []
        leaves = leaves_of(ask)
        terms = list(dict.fromkeys([*words, *(w for x in leaves if x.kind != "prefix" for w in x.words)]))
        begun = list(dict.fromkeys([*prefixes, *(x.words[0] for x in leaves if x.kind == "prefix")]))
        hits = self._hits(terms, begun, view)
        idf = self._frequencies(hits, terms, begun, view).select("term", (p.idf(F.col("df").cast("double"), F.lit(view.n)) * self._weight(words, prefixes)).alias("_idf"))
        base = 0.0
        if p.missing():
            base = (idf.agg(F.sum("_idf")).first()[0] or 0.0) * p.missing()
        gain = F.col("_idf") * (p.tfc(F.col("tf").cast("double"), F.col("_dl"), F.lit(view.length / view.n if view.n else 0.0)) - p.missing())
        has, used = {}, []
        for i, x in enumerate(leaves):
            if x.kind == "phrase":
                for w in x.words:
                    used.append(F.max(F.when(F.col("term") == w, F.col("pos"))).alias(f"_p{terms.index(w)}"))
                has[x] = self._phrase(x, terms)
            else:
                test = F.col("term").startswith(x.words[0]) if x.kind == "prefix" else F.col("term") == x.words[0]
                used.append(F.max(test).alias(f"_l{i}"))
                has[x] = F.coalesce(F.col(f"_l{i}"), F.lit(False))
        used = list({str(c): c for c in used}.values())
        got = hits.join(idf, "term").groupBy(key).agg(F.sum(gain).alias("_gain"), *used)
        if ask is None:
            return got, base
        if holds_of_nothing(ask):
            got = view.rows.select(key).join(got, key, "left").withColumn("_gain", F.coalesce("_gain", F.lit(0.0)))
        return got.filter(truth(ask, lambda x: has[x])).select(key, "_gain"), base

    @staticmethod
    def _phrase(x: Leaf, terms: list[str]) -> Column:
        """Whether the words stand one behind the other: their positions, each moved back by its place in the phrase, have one in common."""
        moved = lambda w, i: F.transform(F.col(f"_p{terms.index(w)}"), lambda p: p - i)
        at = [moved(w, i) for i, w in enumerate(x.words)]
        return F.coalesce(F.size(reduce(F.array_intersect, at)) > 0, F.lit(False))

    def members(self, filters: dict | str, view: View | None = None) -> DataFrame:
        """The keys of the rows that a filter keeps: from the scope's postings where it asks for values of scoped columns alone, else by a scan of its columns."""
        view, key = view or self._view(), self.manifest["key"]
        spec = json.loads(filters) if isinstance(filters, str) else filters
        test = predicate(view.docs, spec)  # its errors come first
        wanted = equalities(spec, self.manifest["scope"])
        if wanted is None:
            return view.rows.filter(test).select(key)
        scope = self.table("scope")
        kinds = {f.name: f.dataType for f in view.docs.schema}
        parts = []
        for c, values in wanted.items():
            kind = kinds[c].elementType if isinstance(kinds[c], T.ArrayType) else kinds[c]
            text = [F.lit(v).cast(kind).cast("string") for v in values if v is not None]  # as the index has written it
            parts.append(scope.filter((F.col("col") == c) & (F.col("value").isin(*text) if text else F.lit(False))).select(key).distinct())
        kept = reduce(lambda a, b: a.join(b, key, "left_semi"), parts)
        if view.changed is None:
            return kept
        return kept.join(view.changed, key, "left_anti").union(view.new.filter(predicate(view.new, spec)).select(key))

    def _answer(self, words: dict[str, float], q: Query | None, k: int, filters, allowed: DataFrame | None, mask: Column | None, digits: int) -> DataFrame:
        key, view = self.manifest["key"], self._view()
        filling = q is None or q.simple
        if not self.manifest["create_empty_token"] and not words and filling and not (q and q.prefixes):
            raise QueryError("no token of the query is known")
        gains, base = self._gains(words, q, view)
        keys = None
        if filters:
            keys = self.members(filters, view)
        if allowed is not None:
            only = allowed.select(key).distinct()
            keys = only if keys is None else keys.join(only, key, "left_semi")
        order = [F.col("score").desc(), F.col(key)]
        score = lambda c: F.round(c + float(base), digits)
        if mask is not None or k > HELD:  # every row can be anywhere: gains meet all keys, and nothing else of the rows
            rows = view.rows.withColumn("_mask", F.lit(1.0) if mask is None else mask).select(key, "_mask")
            rows = rows if keys is None else rows.join(keys, key, "left_semi")
            rows = rows.join(gains, key, "left" if filling else "inner")
            best = rows.select(key, score(F.coalesce("_gain", F.lit(0.0)) * F.col("_mask")).alias("score")).orderBy(*order).limit(k)
            return view.rows.drop("_dl").join(best, key).orderBy(*order)
        if keys is not None:
            gains = gains.join(keys, key, "left_semi")
        found = gains.select(key, score(F.col("_gain")).alias("score"))
        if filling:  # rows at the base score stand behind these, by key
            found = found.filter(F.col("score") > round(base, digits))
        best = [tuple(r) for r in found.orderBy(*order).limit(k).collect()]  # k rows
        if filling and len(best) < k:
            rest = (view.rows.select(key) if keys is None else keys).filter(F.col(key).isNotNull())
            if best:
                rest = rest.filter(~F.col(key).isin(*[r[0] for r in best]))
            best += [(r[0], round(base, digits)) for r in rest.orderBy(key).limit(k - len(best)).collect()]
        kind = T.StructType([T.StructField(key, view.docs.schema[key].dataType), T.StructField("score", T.DoubleType())])
        scores = self.spark.createDataFrame(best, kind)
        rows = view.rows.drop("_dl")
        rows = rows.filter(_among(F.col(key), [r[0] for r in best])) if best else rows.limit(0)
        return rows.join(scores, key).orderBy(*order)

    # ---- changes and maintenance

    def upsert(self, rows: DataFrame, order: str | None = None) -> int:
        """Commit new versions of rows and give the commit's number; a later commit's count. order: a column by which the last of a key's rows counts."""
        return self.append(rows.withColumn("_op", F.lit("upsert")), "_op", order)

    def delete(self, keys: DataFrame) -> int:
        return self.append(keys.select(self.manifest["key"], F.lit("delete").alias("_op")), "_op")

    def append(self, changes: DataFrame, op: str, order: str | None = None, stream: tuple[str, int] | None = None) -> int:
        """Commit upserts and deletes, named by the column `op`, together. stream: (name, batch), of which each is committed once."""
        if not self.manifest["columns"] and not self.manifest["expression"]:
            raise ValueError("an index over a Column is refreshed from its source")
        if stream and self._streamed(stream[0]) >= stream[1]:
            return 0
        cols = [(F.col(f"`{f.name}`") if f.name in changes.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in self._fields()]
        data = uuid.uuid4().hex
        changes.select(*cols, F.col(op).alias("_op"), mutation.sortable(changes, order).alias("_ord")).write.parquet(f"{self.path}/log/u={data}")
        while True:
            n = max([self._folded(), *(int(x.split(".")[0]) for x in self.store.names("_commits"))]) + 1
            if self.store.create(f"_commits/{n:012d}.json", {"data": data, "stream": stream, "at": time.time()}):
                return n

    def _folded(self) -> int:
        return self.open(self.spark, self.path).manifest["folded"]

    def _streamed(self, name: str) -> int:
        """The last batch of a stream that has been committed, folded or not."""
        last = self.open(self.spark, self.path)
        return max([last.manifest["streams"].get(name, -1), *(c["stream"][1] for c in last._commits() if c["stream"] and c["stream"][0] == name)])

    def pending(self) -> int:
        commits = self._commits()
        return self._log(commits).count() if commits else 0

    def maintain(self, least: int = 1) -> dict:
        """Fold the commits into the next version if they hold `least` changes; readers of the old version are not disturbed."""
        commits = self._commits()
        waiting = 0 if not commits else len(commits) if least <= 1 else self._log(commits).count()
        if not commits or waiting < least:
            return {"acted": False, "reason": "no_pending" if not commits else "not_due", "generation": self.manifest["generation"]}
        last = self._latest(commits)
        kept = self.table("docs").drop("_dl").join(mutation.counted(last.select(self.manifest["key"])), self.manifest["key"], "left_anti")
        now = kept.unionByName(self._new(last).select(*kept.columns))
        streams = dict(self.manifest["streams"])
        for c in commits:
            if c["stream"]:
                streams[c["stream"][0]] = max(streams.get(c["stream"][0], -1), c["stream"][1])
        self.manifest = self._next(now, self.manifest["columns"], commits[-1]["n"], streams).manifest
        return {"acted": True, "reason": "folded", "generation": self.manifest["generation"]}

    def maintain_due(self, at: int = FOLD_AT) -> dict:
        return self.maintain(at)

    def try_maintain(self, least: int = 1) -> dict:
        """maintain() under the index's lock; nothing where another holds it. The lock saves work: publishing alone decides between writers."""
        if not self.lock("maintain"):
            return {"acted": False, "reason": "locked", "generation": self.manifest["generation"]}
        try:
            self.manifest = self.open(self.spark, self.path).manifest
            return self.maintain(least)
        finally:
            self.unlock("maintain")

    def lock(self, name: str) -> bool:
        at = f"_locks/{name}.json"
        if self.store.create(at, {"until": time.time() + LEASE}):
            return True
        if self.held(name):
            return False
        self.store.delete(at)
        return self.store.create(at, {"until": time.time() + LEASE})

    def unlock(self, name: str) -> None:
        self.store.delete(f"_locks/{name}.json")

    def held(self, name: str) -> bool:
        return f"{name}.json" in self.store.names("_locks") and self.store.read(f"_locks/{name}.json")["until"] > time.time()

    def refresh(self, source: DataFrame, tokens: Column | str | list[str] | None = None) -> Index:
        """Rebuild from the source as the next version; commits that are there when the call begins are taken as part of the source."""
        seen = max([self.manifest["folded"], *(c["n"] for c in self._commits())])
        return self._next(source, tokens if tokens is not None else self.manifest["columns"], seen, self.manifest["streams"])

    def _next(self, source: DataFrame, tokens, folded: int, streams: dict) -> Index:
        m = self.manifest
        given = {"expression": m["expression"]} if m["expression"] else {"tokens": tokens}
        more = {"where": m["where"], "scope": m["scope"], "create_empty_token": m["create_empty_token"], "options": m["options"], "field_aware": m["field_aware"], "consistency": m["consistency"]}
        return Index.build(self.spark, self.path, source, m["key"], **given, **more, params=self.params, policy=self.policy, generation=m["generation"] + 1, folded=folded, streams=streams)

    def pin(self) -> Index:
        """Register as a reader of this version."""
        self._reader = f"_readers/{uuid.uuid4().hex}.json"
        self.store.create(self._reader, {"generation": self.manifest["generation"], "folded": self.manifest["folded"], "until": time.time() + LEASE})
        return self

    def close(self) -> None:
        if self._reader:
            self.store.delete(self._reader)
            self._reader = None

    def reclaim(self, grace: float = GRACE) -> int:
        """Delete versions older than this one that no reader has pinned, commits that all that stays has folded, and after `grace` seconds log
        folders that no commit names; how many versions there were."""
        generation, folded = self.manifest["generation"], self.manifest["folded"]
        for name in self.store.names("_readers"):
            r = self.store.read(f"_readers/{name}")
            if r["until"] < time.time():
                self.store.delete(f"_readers/{name}")
            else:
                generation, folded = min(generation, r["generation"]), min(folded, r["folded"])
        mine = self.manifest["version"].rsplit("/", 1)[1]
        old = [x for x in self.store.names("") if x.startswith("v=") and x != mine and int(x[2:].split("-")[0]) < generation]
        for x in old:
            self.store.delete(x)
        live = set()
        for name in self.store.names("_commits"):
            n, data = int(name.split(".")[0]), self.store.read(f"_commits/{name}")["data"]
            if n > folded:
                live.add(data)
                continue
            self.store.delete(f"log/u={data}")
            if n < folded:  # the last one stays and tells the next number
                self.store.delete(f"_commits/{name}")
        for x in self.store.names("log"):
            if x[2:] not in live and self.store.age(f"log/{x}") > grace:
                self.store.delete(f"log/{x}")
        return len(old)

    # ---- what it is and how it is

    def status(self) -> dict:
        """The manifest, the changes that wait, and whether queries lag behind them."""
        waiting = self.pending()
        return dict(self.manifest) | {"pending": waiting, "commits": len(self._commits()), "stale": waiting > 0 and self.manifest["consistency"] == "manual"}

    def options(self) -> dict:
        m = self.manifest
        text = vars(self.policy or TextPolicy())
        return m["params"] | {"consistency": m["consistency"], "field_aware": m["field_aware"], "create_empty_token": m["create_empty_token"]} | {f"text_{k}": v for k, v in text.items()} | m["options"]

    def details(self) -> DataFrame:
        m = self.status()
        row = (self.path, m["key"], m["docs"], m["generation"], m["rebuilds"], m["pending"], m["consistency"], m["stale"])
        return self.spark.createDataFrame([row], "index_name string, key string, docs long, generation int, rebuilds int, pending long, consistency string, stale boolean")

    def audit(self) -> DataFrame:
        """(fault, n): what the tables of the version disagree on; no rows where nothing does."""
        key, docs, rows = self.manifest["key"], self.table("docs"), self.table("postings")
        lengths = rows.groupBy(key).agg(F.sum("tf").alias("len"))
        off = docs.select(key, "_dl").join(lengths, key, "left").filter(F.coalesce("len", F.lit(0)) != F.col("_dl")).select(F.lit("length of a row").alias("fault"))
        lost = lengths.join(docs, key, "left_anti").select(F.lit("postings without a row").alias("fault"))
        df = rows.groupBy("term").agg(F.count(F.lit(1)).alias("n")).join(self.table("terms"), "term", "full").filter(~F.col("n").eqNullSafe(F.col("df"))).select(F.lit("document frequency").alias("fault"))
        torn = rows.filter(F.size("pos") != F.col("tf")).select(F.lit("positions").alias("fault"))
        return reduce(DataFrame.unionAll, (off, lost, df, torn)).groupBy("fault").agg(F.count(F.lit(1)).alias("n"))

    def preload(self) -> DataFrame:
        """Cache the vocabulary; results never depend on it."""
        return self.table("terms").persist()

    def clear_cache(self) -> None:
        self.table("terms").unpersist()

    @staticmethod
    def heat(queries: DataFrame, half_life: float, now: float, n: int = 64) -> DataFrame:
        """queries (term, at in seconds): the n terms asked for most, an asking counting half as much for each half-life that has passed."""
        return queries.groupBy("term").agg(F.sum(F.pow(F.lit(0.5), (F.lit(now) - F.col("at")) / half_life)).alias("heat")).orderBy(F.col("heat").desc(), "term").limit(n)


def policy_recommend(profile: str, semantic: bool = False) -> tuple[str, str]:
    """(consistency, maintenance priority) for a workload."""
    if profile not in ("balanced", "query_first", "write_heavy", "write_first"):
        raise ValueError("no such profile")
    if semantic:
        return "eventual", "medium"
    return ("realtime", "high") if profile in ("balanced", "query_first") else ("eventual", "medium")
