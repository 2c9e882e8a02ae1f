"""All queries of the engine over the driver's tables, and the DuckDB SQL they are held against."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as tx
from .operators import evaluate, fields, filters, fusion, semantic, summary
from .operators.index import Index
from .operators.scoring import Bm25, batch_rank, rank, score_rows, top_k
from .operators.store import Store
from .plans.querylang import Prepared, match, match_query, parse
from .sources.tables import table
from .streaming import mutation

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
K = 20
TERMS = {"the": 1.0, "of": 1.0, "thed": 1.0, "que": 2.0, "zzmissing": 1.0}
TOK = "coalesce(regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}_]+'), []::VARCHAR[])"
DOCS = f"d AS (SELECT doc_id, {TOK.format(c='text')} AS tokens, len({TOK.format(c='text')})::DOUBLE AS dl FROM documents)"


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars").withColumn("tokens", tx.simple_tokens(F.col("text")))


def best(scored: DataFrame, key: str = "doc_id") -> DataFrame:
    return top_k(scored.select(key, "score"), key, K, 6)


# ---- DuckDB's side of BM25


def _tfc(p: Bm25, tf: str = "tf") -> str:
    norm = f"({1 - p.b}::DOUBLE + {p.b}::DOUBLE * dl / nullif(avgdl, 0))"
    k1, d = f"{p.k1}::DOUBLE", f"{p.delta}::DOUBLE"
    if p.method in ("robertson", "lucene"):
        return f"({tf} / ({k1} * {norm} + {tf}))"
    if p.method == "atire":
        return f"({tf} * ({k1} + 1) / ({tf} + {k1} * {norm}))"
    if p.method == "bm25l":
        return f"(({k1} + 1) * (coalesce({tf} / {norm}, 0) + {d}) / ({k1} + coalesce({tf} / {norm}, 0) + {d}))"
    return f"(({k1} + 1) * {tf} / ({k1} * {norm} + {tf}) + {d})"


def _idf(p: Bm25) -> str:
    rest = "((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))"
    return {"robertson": f"ln(greatest(1.0::DOUBLE, {rest}))", "lucene": f"ln(1 + {rest})", "atire": "ln(n / df)", "bm25l": "ln((n + 1) / (df + 0.5::DOUBLE))", "bm25+": "ln((n + 1) / df)"}[p.idf_method]


def _scored(terms: dict[str, float], p: Bm25 | None = None, docs: str = DOCS, key: str = "doc_id", mask: str = "1", where: str = "") -> str:
    """CTEs ending in sc(key, score, tokens): every document; `where` restricts what is ranked, not the statistics."""
    p = p or Bm25()
    values = ", ".join(f"('{t}', {w}::DOUBLE)" for t, w in terms.items())
    return f"""WITH {docs}, q(term, w) AS (VALUES {values}),
st AS (SELECT count(*)::DOUBLE AS n, coalesce(avg(dl), 0) AS avgdl FROM d),
tf AS (SELECT d.*, q.term, q.w, len(list_filter(tokens, lambda x: x = q.term))::DOUBLE AS tf FROM d, q),
df AS (SELECT term, sum(CASE WHEN tf > 0 THEN 1 ELSE 0 END)::DOUBLE AS df FROM tf GROUP BY term),
sc AS (SELECT {key}, any_value(tokens) AS tokens, round(sum(CASE WHEN df > 0 THEN w * {_idf(p)} * ((coalesce({_tfc(p)}, 0) - {p.missing()}::DOUBLE) * {mask} + {p.missing()}::DOUBLE) ELSE 0 END), 6) AS score
  FROM tf JOIN df USING (term), st {where} GROUP BY {key})"""


def _top(ctes: str, key: str = "doc_id", where: str = "") -> str:
    return f"{ctes} SELECT {key}, score FROM sc {where} ORDER BY score DESC, {key} LIMIT {K}"


# ---- build


@query("idx_postings", f"WITH {DOCS}, t AS (SELECT doc_id, unnest(tokens) AS term FROM d) SELECT term, doc_id, count(*) AS tf FROM t GROUP BY ALL")
def idx_postings(spark, sf):
    return documents(spark, sf).select("doc_id", F.explode("tokens").alias("term")).groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf"))


@query("idx_term_stats", f"WITH {DOCS}, t AS (SELECT doc_id, unnest(tokens) AS term FROM d) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM t GROUP BY term")
def idx_term_stats(spark, sf):
    per = idx_postings(spark, sf)
    return per.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


LINES = "d AS (SELECT l_orderkey AS doc_id, list(l_partkey % 1000) AS tokens, count(*)::DOUBLE AS dl FROM lineitem GROUP BY l_orderkey)"


def order_ids(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.collect_list(F.col("l_partkey") % 1000).alias("tokens"))


@query("idx_from_ids", "SELECT l_partkey % 1000 AS term, l_orderkey AS doc_id, count(*) AS tf FROM lineitem GROUP BY ALL")
def idx_from_ids(spark, sf):
    return order_ids(spark, sf).select("doc_id", F.explode("tokens").alias("term")).groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf"))


@query("idx_expression", f"WITH t AS (SELECT p_partkey, unnest({TOK.format(c='''coalesce(p_name, '') || ' ' || coalesce(p_type, '')''')}) AS term FROM part) SELECT term, count(DISTINCT p_partkey) AS df FROM t GROUP BY term")
def idx_expression(spark, sf):
    text = F.concat_ws(" ", F.coalesce("p_name", F.lit("")), F.coalesce("p_type", F.lit("")))
    return table(spark, sf, "part").select("p_partkey", F.explode(tx.simple_tokens(text)).alias("term")).distinct().groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def folder(spark: SparkSession) -> str:
    """A place for an index in the folder that driver and executors share, deleted when the driver ends; one is made only where none is set, in local tests."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="quillrank-")
        spark.conf.set("spark.checkpoint.dir", at)
    path = f"{at.rstrip('/')}/index-{uuid.uuid4().hex}"

    def drop() -> None:
        with contextlib.suppress(Exception):
            Store(spark, path).delete()

    atexit.register(drop)
    return path


def built(spark, sf, docs: DataFrame | None = None) -> Index:
    docs = documents(spark, sf) if docs is None else docs
    return Index.build(spark, folder(spark), docs.drop("tokens"), "doc_id", tx.simple_tokens(F.col("text")))


@query("idx_query", _top(_scored(TERMS | {"que": 1.0})))
def idx_query(spark, sf):
    return built(spark, sf).query(" ".join(TERMS), K).select("doc_id", "score")


@query("idx_refresh", _top(_scored({"the": 1, "of": 1})))
def idx_refresh(spark, sf):
    docs = documents(spark, sf)
    index = built(spark, sf, docs.filter("doc_id % 2 = 0"))
    return index.refresh(docs.drop("tokens"), tx.simple_tokens(F.col("text"))).query("the of", K).select("doc_id", "score")


def indexed(name: str, q: str, weights: dict[str, float], where: str) -> None:
    """A raw query answered from postings, positions and flags."""

    def run(spark, sf):
        return built(spark, sf).query(q, K).select("doc_id", "score")

    query(name, _top(_scored(weights), where=where))(run)


@query("idx_details", "SELECT 'doc_id' AS key, count(*) AS docs, 1::INTEGER AS generation, 0::INTEGER AS rebuilds, 0::BIGINT AS pending, 'realtime' AS consistency, false AS stale FROM documents")
def idx_details(spark, sf):
    return built(spark, sf).details().drop("index_name")


@query(
    "idx_evidence",
    f"""WITH {DOCS}, t AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, dl, unnest(tokens) AS term FROM d) GROUP BY ALL),
st AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM d),
s AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf, max(tf)::DOUBLE AS tf, min(dl) AS dl FROM t WHERE term IN ('the', 'que') OR starts_with(term, 'thedin') GROUP BY term)
SELECT term, df, cf, CASE WHEN term = 'the' THEN 2.0 ELSE 1.0 END::DOUBLE AS weight, round({_idf(Bm25())}, 6) AS idf, round({_idf(Bm25())} * CASE WHEN term = 'the' THEN 2.0 ELSE 1.0 END * {_tfc(Bm25())}, 6) AS bound FROM s, st""",
)
def idx_evidence(spark, sf):
    return built(spark, sf).evidence("the que the thedin*")


@query("idx_members", "SELECT doc_id FROM documents WHERE lang IN ('en', 'fr') AND source = 'src1'")
def idx_members(spark, sf):
    index = Index.build(spark, folder(spark), documents(spark, sf).drop("tokens"), "doc_id", "text", scope=["lang", "source"])
    return index.members({"lang": {"in": ["en", "fr"]}, "source": {"eq": "src1"}})


@query("idx_partial", _top(_scored({"the": 1, "src1": 1}, docs=DOCS.replace(TOK.format(c="text"), TOK.format(c="text || ' ' || coalesce(source, '')")).replace("FROM documents", "FROM documents WHERE doc_id % 5 <> 2"))))
def idx_partial(spark, sf):
    """Over an SQL expression and a part of the rows, both of which the index remembers."""
    words = r"regexp_extract_all(lower(concat(text, ' ', coalesce(source, ''))), '[\\p{L}\\p{N}_]+', 0)"
    index = Index.build(spark, folder(spark), documents(spark, sf).drop("tokens"), "doc_id", expression=words, where="doc_id % 5 <> 2")
    return index.query("the src1", K).select("doc_id", "score")


@query("idx_audit", "SELECT 'none'::VARCHAR AS fault, 0::BIGINT AS n WHERE false")
def idx_audit(spark, sf):
    return built(spark, sf).audit()


# ---- text

def _tokens_sql(e: str) -> str:
    return f"SELECT doc_id, array_to_string({e}, ' ') AS tokens FROM (SELECT doc_id, {TOK.format(c='text')} AS t FROM documents)"



@query("text_tokenize", _tokens_sql("t"))
def text_tokenize(spark, sf):
    return documents(spark, sf).select("doc_id", F.array_join("tokens", " ").alias("tokens"))


#: The same words without look-around, for texts without ideographs.
_WORDS_SQL = "regexp_extract_all(replace(lower(nfc_normalize(text)), 'ß', 'ss'), '(?:(?:\\p{L}[''’.:·])+\\p{L}|(?:\\p{N}[.,;''])+\\p{N}|[\\p{L}\\p{N}\\p{M}_])+')"


@query("text_words", f"SELECT doc_id, array_to_string(coalesce({_WORDS_SQL}, []::VARCHAR[]), ' ') AS tokens FROM documents")
def text_words(spark, sf):
    return documents(spark, sf).select("doc_id", F.array_join(tx.tokenize(F.col("text")), " ").alias("tokens"))


@query("text_normalize_tokens", _tokens_sql("list_filter(list_transform(t, lambda x: strip_accents(replace(x, 'ß', 'ss'))), lambda x: x NOT IN ('the', 'of', 'la'))"))
def text_normalize_tokens(spark, sf):
    policy = tx.TextPolicy(fold_diacritics=True, stopwords=("the", "of", "la"))
    return documents(spark, sf).select("doc_id", F.array_join(tx.normalize_tokens(F.col("tokens"), policy), " ").alias("tokens"))


@query("text_casefold", "SELECT doc_id, replace(lower(nfc_normalize(text)), 'ß', 'ss') AS folded FROM documents")
def text_casefold(spark, sf):
    return documents(spark, sf).select("doc_id", tx.case_fold(tx.nfc(F.col("text"))).alias("folded"))


@query("text_fold_diacritics", "SELECT doc_id, strip_accents(text) AS folded FROM documents")
def text_fold_diacritics(spark, sf):
    return documents(spark, sf).select("doc_id", tx.fold_diacritics(F.col("text")).alias("folded"))


@query("text_stopwords", _tokens_sql("list_filter(t, lambda x: x NOT IN ('the', 'of', 'and', 'la', 'de', 'der', 'und'))"))
def text_stopwords(spark, sf):
    stop = tx.TextPolicy.stopword_list("the, of,and, la,de , der, und")
    return documents(spark, sf).select("doc_id", F.array_join(F.filter("tokens", lambda t: ~t.isin(*stop)), " ").alias("tokens"))


@query("text_stem")
def text_stem(spark, sf):
    return documents(spark, sf).select("doc_id", F.array_join(tx.stem_tokens(F.col("tokens")), " ").alias("tokens"))


_MARK = "list_transform(t, lambda x: CASE WHEN x IN ('the', 'que') OR starts_with(x, 'thed') THEN '<b>' || x || '</b>' ELSE x END)"


@query("text_highlight", f"SELECT doc_id, array_to_string({_MARK}, ' ') AS html FROM (SELECT doc_id, {TOK.format(c='text')} AS t FROM documents)")
def text_highlight(spark, sf):
    return documents(spark, sf).select("doc_id", tx.highlight(F.col("tokens"), ["the", "que"], ["thed"]).alias("html"))


@query(
    "text_snippet",
    f"""SELECT doc_id, CASE WHEN s > 1 THEN '... ' ELSE '' END || array_to_string(m[s:s + 7], ' ') || CASE WHEN s + 8 <= len(m) THEN ' ...' ELSE '' END AS snippet
FROM (SELECT *, greatest(1, least(f - 4, len(m) - 8 + 1)) AS s FROM (SELECT doc_id, {_MARK} AS m,
  greatest(coalesce(list_position(list_transform(t, lambda x: x IN ('the', 'que') OR starts_with(x, 'thed')), true), 1), 1) AS f FROM (SELECT doc_id, {TOK.format(c="text")} AS t FROM documents)))""",
)
def text_snippet(spark, sf):
    return documents(spark, sf).select("doc_id", tx.snippet(F.col("tokens"), ["the", "que"], ["thed"], max_tokens=8).alias("snippet"))


# ---- query language and scoring

for _name, _p in {"lucene": Bm25(), "robertson": Bm25("robertson"), "atire": Bm25("atire"), "bm25l": Bm25("bm25l"), "plus": Bm25("bm25+"), "mixed_idf": Bm25("atire", "bm25+", 1.2, 0.6)}.items():

    def _variant(spark, sf, p=_p):
        docs = documents(spark, sf)
        return best(score_rows(docs, F.col("tokens"), TERMS, p))

    query(f"bm25_{_name}", _top(_scored(TERMS, _p)))(_variant)


def has(*terms: str) -> str:
    return " AND ".join(f"list_contains(tokens, '{t}')" for t in terms)


def phrase_sql(*words: str) -> str:
    return f"contains(' ' || array_to_string(tokens, ' ') || ' ', ' {' '.join(words)} ')"


def ranked(name: str, q: str, weights: dict[str, float], where: str) -> None:
    def run(spark, sf):
        return best(rank(documents(spark, sf), F.col("tokens"), q))

    query(name, _top(_scored(weights), where=where))(run)


ranked("bm25_must_mustnot", "+the thed of -que", {"the": 1, "thed": 1, "of": 1}, f"WHERE {has('the')} AND NOT {has('que')}")
ranked("bm25_boolean", '(the AND thed) OR (que AND NOT der) OR "of the"', {"the": 2, "thed": 1, "que": 1, "of": 1}, f"WHERE ({has('the', 'thed')}) OR ({has('que')} AND NOT {has('der')}) OR {phrase_sql('of', 'the')}")
ranked("bm25_phrase", '"in the"', {"in": 1, "the": 1}, f"WHERE {phrase_sql('in', 'the')}")
ranked("bm25_zero_fill", "zzmissing que", {"zzmissing": 1, "que": 1}, "")


@query(
    "bm25_prefix",
    _scored({"the": 1}).replace("VALUES ('the', 1::DOUBLE)", "SELECT t, sum(w) FROM (SELECT 'the' AS t, 1::DOUBLE AS w UNION ALL SELECT DISTINCT t, 1::DOUBLE FROM (SELECT unnest(tokens) AS t FROM d) WHERE starts_with(t, 'thedin')) GROUP BY t")
    + f" SELECT doc_id, score FROM sc ORDER BY score DESC, doc_id LIMIT {K}",
)
def bm25_prefix(spark, sf):
    return best(rank(documents(spark, sf), F.col("tokens"), "thedin* the"))


def matched(name: str, q: str, where: str) -> None:
    def run(spark, sf):
        docs = documents(spark, sf)
        return docs.filter(match(parse(q).root, F.col("tokens"))).select("doc_id")

    query(name, f"WITH {DOCS} SELECT doc_id FROM d WHERE {where}")(run)


matched("match_term", "que", has("que"))
matched("match_boolean", '(the OR que) AND NOT thed', f"({has('the')} OR {has('que')}) AND NOT {has('thed')}")
matched("match_not_only", "NOT the", f"NOT {has('the')}")


@query("match_prepared", f"WITH {DOCS} SELECT doc_id FROM d WHERE len(list_filter(tokens, lambda x: strip_accents(x) IN ('reaon', 'etre', 'que'))) > 0")
def match_prepared(spark, sf):
    """Normalised on both sides by the query's own options."""
    docs = documents(spark, sf)
    return docs.filter(match_query(docs, "tokens", Prepared("REAON être QUE", fold_diacritics=True))).select("doc_id")


@query("match_query_text", f"SELECT doc_id FROM documents WHERE list_contains({_WORDS_SQL}, 'que') AND NOT list_contains({_WORDS_SQL}, 'aux')")
def match_query_text(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.filter(match_query(docs, "text", Prepared("QUE AND NOT aux"))).select("doc_id")


@query("order_tokens", "SELECT pos::INTEGER AS pos, token FROM (VALUES (0, 'cafe'), (1, 'and'), (2, 'run')) t(pos, token)")
def order_tokens(spark, sf):
    got = Prepared("+CAFÉ (and) -the running", stopwords=("the",), stem_english=True, fold_diacritics=True).order_tokens()
    return spark.createDataFrame(list(enumerate(got)), "pos int, token string")


@query("match_then_order", _top(_scored({"que": 1, "of": 1}), where=f"WHERE {has('the')}"))
def match_then_order(spark, sf):
    docs = documents(spark, sf)
    hits = docs.filter(match(parse("the AND the").root, F.col("tokens")))
    return best(rank(hits, F.col("tokens"), "que of", corpus=docs))


@query("bm25_with_deletes", _top(_scored(TERMS, docs=DOCS.replace("FROM documents", "FROM documents WHERE doc_id % 7 <> 3"))))
def bm25_with_deletes(spark, sf):
    docs = documents(spark, sf)
    retired = docs.filter("doc_id % 7 = 3").select("doc_id")
    return best(score_rows(docs.join(retired, "doc_id", "left_anti"), F.col("tokens"), TERMS, Bm25()))


def _begun(weight: int) -> str:
    """The term "the" at a weight, and whatever "a" begins; only rows with the latter."""
    both = f"SELECT t, sum(w) FROM (SELECT 'the' AS t, {weight}::DOUBLE AS w UNION ALL SELECT DISTINCT t, 1::DOUBLE FROM (SELECT unnest(tokens) AS t FROM d) WHERE starts_with(t, 'a')) GROUP BY t"
    return _top(_scored({"the": 1}).replace("VALUES ('the', 1.0::DOUBLE)", both).replace("VALUES ('the', 1::DOUBLE)", both), where="WHERE len(list_filter(tokens, lambda x: starts_with(x, 'a'))) > 0")


@query("bm25_must_prefix", _begun(1))
def bm25_must_prefix(spark, sf):
    """A prefix that a large part of the vocabulary begins with: its terms are a table, in the scan as in the index."""
    return best(rank(documents(spark, sf), F.col("tokens"), "+a* the"))


@query("idx_prefix", _begun(0))
def idx_prefix(spark, sf):
    return built(spark, sf).query("+a*", K).select("doc_id", "score")


@query("bm25_weight_mask", _top(_scored(TERMS, Bm25("bm25+"), mask="(CASE doc_id % 4 WHEN 0 THEN 1 WHEN 1 THEN -1 WHEN 2 THEN 0.5 ELSE 2 END)::DOUBLE")))
def bm25_weight_mask(spark, sf):
    m = F.col("doc_id") % 4
    mask = F.when(m == 0, 1.0).when(m == 1, -1.0).when(m == 2, 0.5).otherwise(2.0)
    return best(score_rows(documents(spark, sf), F.col("tokens"), TERMS, Bm25("bm25+"), mask=mask))


@query("topk_subset", _top(_scored(TERMS, where="WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")))
def topk_subset(spark, sf):
    docs = documents(spark, sf)
    allowed = table(spark, sf, "labels").filter("toxic = 1").select("doc_id")
    return best(score_rows(docs.join(allowed, "doc_id", "left_semi"), F.col("tokens"), TERMS, Bm25(), corpus=docs))


IDS = {7: 1.0, 77: 1.0, 300: 2.0, 100000: 1.0}


@query("bm25_ids", _top(_scored({str(k): v for k, v in IDS.items()}, docs=LINES.replace("list(l_partkey % 1000)", "list((l_partkey % 1000)::VARCHAR)"))))
def bm25_ids(spark, sf):
    docs = order_ids(spark, sf).withColumn("tokens", F.col("tokens").cast("array<string>"))
    return best(score_rows(docs, F.col("tokens"), {str(k): v for k, v in IDS.items()}, Bm25()))


@query("bm25_tokens", _top(_scored({"thing": 2, "nothere": 1})))
def bm25_tokens(spark, sf):
    return best(rank(documents(spark, sf), F.col("tokens"), "thing thing nothere"))


_OVERLAP = f"WITH {DOCS} SELECT doc_id, @SIGN((CASE WHEN {has('the')} THEN 2 ELSE 0 END) + (CASE WHEN {has('que')} THEN 1 ELSE 0 END))::DOUBLE AS @COLUMN FROM d"


@query("overlap_distance", _OVERLAP.replace("@SIGN", "0.0 - ").replace("@COLUMN", "distance"))
def overlap_distance(spark, sf):
    return documents(spark, sf).select("doc_id", (F.lit(0.0) - tx.overlap(F.col("tokens"), ["the", "que", "the"])).alias("distance"))


@query("score_local", _OVERLAP.replace("@SIGN", "").replace("@COLUMN", "score"))
def score_local(spark, sf):
    return documents(spark, sf).select("doc_id", tx.overlap(F.col("tokens"), ["the", "que", "the"]).cast("double").alias("score"))


@query(
    "bm25_batch",
    f"""WITH {DOCS}, q AS (SELECT item_id AS query_id, term, count(*)::DOUBLE AS w FROM (SELECT item_id, unnest({TOK.format(c="text")}) AS term FROM benchmark) GROUP BY ALL),
st AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM d),
tf AS (SELECT doc_id, dl, term, count(*)::DOUBLE AS tf FROM (SELECT doc_id, dl, unnest(tokens) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*)::DOUBLE AS df FROM tf GROUP BY term),
im AS (SELECT doc_id, term, {_idf(Bm25())} * {_tfc(Bm25())} AS impact FROM tf JOIN df USING (term), st),
sc AS (SELECT query_id, doc_id, round(sum(impact * w), 6) AS score FROM im JOIN q USING (term) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc)
SELECT query_id, doc_id, score, rank::INTEGER AS rank FROM r WHERE rank <= {K}""",
)
def bm25_batch(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(tx.simple_tokens(F.col("text"))).alias("term"))
    return batch_rank(docs, "doc_id", tx.simple_tokens(F.col("text")), q, Bm25(), K)


def _batch_sql(p: Bm25) -> str:
    base = f"SELECT query_id, sum(w * {_idf(p)}) * {p.missing()}::DOUBLE AS base FROM q JOIN df USING (term), st GROUP BY query_id"
    sql = ORACLES["bm25_batch"].replace(_idf(Bm25()) + " * " + _tfc(Bm25()), f"{_idf(p)} * ({_tfc(p)} - {p.missing()}::DOUBLE)")
    return sql.replace("sc AS (SELECT query_id, doc_id, round(sum(impact * w), 6) AS score FROM im JOIN q USING (term) GROUP BY ALL)", f"b AS ({base}),\nsc AS (SELECT query_id, doc_id, round(sum(impact * w) + any_value(base), 6) AS score FROM im JOIN q USING (term) JOIN b USING (query_id) GROUP BY query_id, doc_id)")


def benchmark_terms(spark, sf) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(tx.simple_tokens(F.col("text"))).alias("term"))


for _name, _p in {"plus": Bm25("bm25+"), "l": Bm25("bm25l"), "atire": Bm25("atire"), "robertson": Bm25("robertson")}.items():

    def _batch(spark, sf, p=_p):
        docs = table(spark, sf, "documents").select("doc_id", "text")
        return batch_rank(docs, "doc_id", tx.simple_tokens(F.col("text")), benchmark_terms(spark, sf), p, K)

    query(f"bm25_batch_{_name}", _batch_sql(_p))(_batch)


@query("idx_batch", _batch_sql(Bm25("bm25+")))
def idx_batch(spark, sf):
    docs = documents(spark, sf).drop("tokens")
    index = Index.build(spark, folder(spark), docs, "doc_id", tx.simple_tokens(F.col("text")), params=Bm25("bm25+"))
    return index.query_batch(benchmark_terms(spark, sf), K)


indexed("idx_must_mustnot", "+the thed of -que", {"the": 1, "thed": 1, "of": 1}, f"WHERE {has('the')} AND NOT {has('que')}")
indexed("idx_boolean", '(the AND thed) OR (que AND NOT der) OR "of the"', {"the": 2, "thed": 1, "que": 1, "of": 1}, f"WHERE ({has('the', 'thed')}) OR ({has('que')} AND NOT {has('der')}) OR {phrase_sql('of', 'the')}")
indexed("idx_phrase", '"in the"', {"in": 1, "the": 1}, f"WHERE {phrase_sql('in', 'the')}")
indexed("idx_not_only", "NOT the", {"zzmissing": 1}, f"WHERE NOT {has('the')}")


# ---- fields

PART_TERMS = {"green": 1.0, "steel": 1.0, "brass": 1.0, "small": 1.0}
_NAME, _TYPE = TOK.format(c="p_name"), TOK.format(c="p_type")
PARTS = f"d AS (SELECT p_partkey, {_NAME} || {_TYPE} AS tokens, len({_NAME} || {_TYPE})::DOUBLE AS dl FROM part)"


def parts(spark, sf):
    return table(spark, sf, "part").withColumns({"name_tokens": tx.simple_tokens(F.col("p_name")), "type_tokens": tx.simple_tokens(F.col("p_type"))})


@query("bm25_fused", _top(_scored(PART_TERMS, docs=PARTS, key="p_partkey"), key="p_partkey"))
def bm25_fused(spark, sf):
    return best(score_rows(parts(spark, sf), fields.fused(F.col("name_tokens"), F.col("type_tokens")), PART_TERMS, Bm25()), "p_partkey")


def _fields_sql(a: float, b: float) -> str:
    one = lambda c: PARTS.replace(f"{_NAME} || {_TYPE} AS tokens", f"{c} AS tokens")
    side = lambda c: _scored(PART_TERMS, docs=one(c), key="p_partkey").replace("round(sum(", "(sum(").replace("), 6) AS score", ")) AS score").replace(", 6) AS score", ") AS score")
    return f"SELECT p_partkey, round(a.score * {a} + b.score * {b}, 6) AS score FROM ({side(_NAME)} SELECT p_partkey, score FROM sc) a JOIN ({side(_TYPE)} SELECT p_partkey, score FROM sc) b USING (p_partkey) ORDER BY score DESC, p_partkey LIMIT {K}"


for _label, _w in {"bm25_field_equal": (1.0, 1.0), "bm25_field_weighted": (3.0, 0.5)}.items():

    def _by_field(spark, sf, w=_w):
        cols = {"p_name": F.col("name_tokens"), "p_type": F.col("type_tokens")}
        return best(fields.rank_fields(parts(spark, sf), cols, " ".join(PART_TERMS), list(w)), "p_partkey")

    query(_label, _fields_sql(*_w))(_by_field)


@query("idx_field_weighted", _fields_sql(3.0, 0.5))
def idx_field_weighted(spark, sf):
    docs = table(spark, sf, "part").select("p_partkey", "p_name", "p_type")
    index = Index.build(spark, folder(spark), docs, "p_partkey", ["p_name", "p_type"], field_aware=True)
    return index.query_fields(" ".join(PART_TERMS), {"p_name": 3.0, "p_type": 0.5}, K).select("p_partkey", "score")


@query("idx_fused", _top(_scored(PART_TERMS, docs=PARTS, key="p_partkey"), key="p_partkey"))
def idx_fused(spark, sf):
    docs = table(spark, sf, "part").select("p_partkey", "p_name", "p_type")
    return Index.build(spark, folder(spark), docs, "p_partkey", ["p_name", "p_type"]).query(" ".join(PART_TERMS), K).select("p_partkey", "score")


# ---- filters


def filtered(name: str, spec: dict, where: str) -> None:
    def run(spark, sf):
        df = parts(spark, sf)
        return df.filter(filters.predicate(df, spec)).select("p_partkey", "p_name")

    query(name, f"SELECT p_partkey, p_name FROM part WHERE {where}")(run)


filtered("filter_eq", {"p_size": {"eq": 7}}, "p_size = 7")
filtered("filter_in", {"p_size": {"in": [1, 5, 9]}, "p_brand": {"in": ["Brand#11", "Brand#23", "Brand#45"]}}, "p_size IN (1, 5, 9) AND p_brand IN ('Brand#11', 'Brand#23', 'Brand#45')")
filtered("filter_overlap", {"name_tokens": {"overlap": ["green", "red", "a"]}}, f"list_has_any({_NAME}, ['green', 'red', 'a'])")
filtered("filter_ilike", {"p_type": {"ilike": "%aNd_Rd"}}, "p_type ILIKE '%aNd_Rd'")
filtered("filter_ilike_any", {"type_tokens": {"ilike_any": ["sm%", "%plated"]}}, f"len(list_filter({_TYPE}, lambda x: x ILIKE 'sm%' OR x ILIKE '%plated')) > 0")
filtered("filter_range", {"p_retailprice": {"range": {"gte": 905.5, "lt": 912.3}}, "p_size": {"range": {"gt": 10}}}, "p_retailprice >= 905.5 AND p_retailprice < 912.3 AND p_size > 10")


@query("bm25_filtered_topk", _top(_scored(TERMS, where="WHERE lang = 'en' AND n_chars BETWEEN 500 AND 3000", docs=DOCS.replace("SELECT doc_id,", "SELECT doc_id, lang, n_chars,"))))
def bm25_filtered_topk(spark, sf):
    docs = documents(spark, sf)
    keep = filters.predicate(docs, {"lang": {"eq": "en"}, "n_chars": {"range": {"gte": 500, "lte": 3000}}})
    return best(score_rows(docs.filter(keep), F.col("tokens"), TERMS, Bm25(), corpus=docs))


@query(
    "natural_ranked_sql",
    _scored({"the": 1, "of": 1}, docs=DOCS.replace("SELECT doc_id,", "SELECT doc_id, source,"), where="WHERE source IN ('src1', 'src2')") + f" SELECT doc_id, score, coalesce(quality, -1) AS quality FROM sc LEFT JOIN labels USING (doc_id) ORDER BY score DESC, doc_id LIMIT {K}",
)
def natural_ranked_sql(spark, sf):
    docs = documents(spark, sf)
    ranked_docs = rank(docs.filter("source IN ('src1', 'src2')"), F.col("tokens"), "the of", corpus=docs)
    return spark.sql(
        f"SELECT doc_id, score, coalesce(quality, -1) AS quality FROM {{ranked}} LEFT JOIN {{labels}} USING (doc_id) ORDER BY score DESC, doc_id LIMIT {K}",
        ranked=ranked_docs.withColumn("score", F.round("score", 6)),
        labels=table(spark, sf, "labels"),
    )


# ---- fusion


def _hits_sql(terms: dict[str, float], k: int = K) -> str:
    return f"(SELECT doc_id, score FROM ({_scored(terms)} SELECT doc_id, score FROM sc ORDER BY score DESC, doc_id LIMIT {k}))"


def hits(spark, sf, terms: dict[str, float], k: int = K) -> DataFrame:
    return top_k(score_rows(documents(spark, sf), F.col("tokens"), terms, Bm25()).select("doc_id", "score"), "doc_id", k, 6)


def _fused_sql(*sources: tuple[dict, float, int], k: int = K) -> str:
    union = " UNION ALL ".join(f"SELECT doc_id, score * {w}::DOUBLE AS score FROM {_hits_sql(t, n)}" for t, w, n in sources)
    return f"SELECT doc_id, round(sum(score), 6) AS score FROM ({union}) GROUP BY doc_id ORDER BY score DESC, doc_id::VARCHAR LIMIT {k}"


A, B, C = {"the": 1.0, "thed": 1.0}, {"of": 1.0, "que": 1.0}, {"der": 1.0, "in": 1.0}


@query("fusion_pair", _fused_sql((A, 2.0, 20), (B, 1.0, 20)))
def fusion_pair(spark, sf):
    return fusion.fuse_hits([(hits(spark, sf, A), 2.0), (hits(spark, sf, B), None)], K)


@query("fusion_weighted", _fused_sql((A, 2.0, 50), (B, 0.5, 50), (C, 1.0, 50)))
def fusion_weighted(spark, sf):
    return fusion.fuse_hits([(hits(spark, sf, t, 50), w) for t, w in ((A, 2.0), (B, 0.5), (C, 1.0))], K)


@query("fusion_fields", _fused_sql((A, 1.0, 20), (C, 3.0, 20)))
def fusion_fields(spark, sf):
    index = built(spark, sf)
    named = [fusion.FieldQuery(index, " ".join(A), None, "title"), fusion.FieldQuery(index, " ".join(C), 3.0, "body")]
    return fusion.fuse_queries(named, K).select("doc_id", "score")


@query("fusion_text", _fused_sql(({"the": 1.0, "of": 1.0}, 2.5, 50)))
def fusion_text(spark, sf):
    index = built(spark, sf)
    return fusion.fuse_text({"near": (index, 2.0), "far": (index, 0.5)}, "the of", K, 50).select("doc_id", "score")


_BM = f"SELECT 'bm25' AS source_name, doc_id AS key, score AS raw_value, row_number() OVER (ORDER BY score DESC, doc_id::VARCHAR)::INTEGER AS source_rank FROM {_hits_sql(B, 100)}"
_DIST = "(SELECT vec_id AS key, round(sqrt(list_sum(list_transform(range(1, len(embedding) + 1), lambda i: (embedding[i]::DOUBLE - q[i]::DOUBLE) * (embedding[i]::DOUBLE - q[i]::DOUBLE)))), 6) AS raw_value FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = 0))"


@query("hybrid_bm25_candidates", _BM)
def hybrid_bm25_candidates(spark, sf):
    by = Window.partitionBy(F.lit(0)).orderBy(F.col("score").desc(), F.col("doc_id").cast("string"))
    got = hits(spark, sf, B, 100).withColumn("r", F.row_number().over(by))  # a hundred rows
    return fusion.candidates(got, "bm25", F.col("doc_id"), F.col("score"), rank=F.col("r")).select("source_name", "key", "raw_value", "source_rank")


def distances(spark, sf) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    q = vectors.filter("vec_id = 0").select("embedding").first().embedding
    return vectors.select(F.col("vec_id").alias("key"), F.round(fusion.vector_distance(F.col("embedding"), q), 6).alias("raw_value"))


@query("vector_topk", f"SELECT key, raw_value FROM {_DIST} ORDER BY raw_value, key LIMIT {K}")
def vector_topk(spark, sf):
    return distances(spark, sf).orderBy("raw_value", "key").limit(K)


_ONE = {
    "rrf": "1.0 / (60.0 + rank)",
    "minmax": "CASE WHEN hi = lo THEN 1.0 WHEN low THEN (hi - raw_value) / (hi - lo) ELSE (raw_value - lo) / (hi - lo) END",
    "zscore": "CASE WHEN sd = 0 THEN 0.0 WHEN low THEN (mean - raw_value) / sd ELSE (raw_value - mean) / sd END",
    "rank": "1.0 / greatest(rank, 1)",
    "inverse": "1.0 / greatest(1e-6, raw_value + 1e-6)",
}

for _kind, _sql in _ONE.items():

    def _hybrid(spark, sf, kind=_kind):
        norm = "identity" if kind == "rrf" else kind
        lex = fusion.candidates(hits(spark, sf, B, 100), "bm25", F.col("doc_id"), F.col("score"), weight=2.0, normalizer=norm)
        near = distances(spark, sf).orderBy("raw_value", "key").limit(100)
        vec = fusion.candidates(near, "vector", F.col("key"), F.col("raw_value"), normalizer=norm, direction="lower")
        out = fusion.hybrid_fuse(lex.unionByName(vec), K, "rrf" if kind == "rrf" else "score")
        return out.select("key", "score", "source_count", F.array_join("source_names", ",").alias("names"), F.array_join("ranks", ",").alias("ranks"))

    query(
        f"hybrid_{_kind}",
        f"""WITH c AS (SELECT 'bm25' AS source_name, doc_id AS key, score AS raw_value, 2.0::DOUBLE AS weight, false AS low FROM {_hits_sql(B, 100)}
UNION ALL SELECT 'vector', key, raw_value, 1.0::DOUBLE, true FROM (SELECT * FROM {_DIST} ORDER BY raw_value, key LIMIT 100)),
r AS (SELECT *, row_number() OVER (PARTITION BY source_name ORDER BY CASE WHEN low THEN -raw_value ELSE raw_value END DESC, key::VARCHAR) AS rank, min(raw_value) OVER w AS lo, max(raw_value) OVER w AS hi, avg(raw_value) OVER w AS mean, stddev_pop(raw_value) OVER w AS sd FROM c WINDOW w AS (PARTITION BY source_name))
SELECT key, round(sum(weight * ({_sql})), 6) AS score, count(*) AS source_count, string_agg(source_name, ',' ORDER BY source_name) AS names, string_agg(rank::VARCHAR, ',' ORDER BY source_name) AS ranks FROM r GROUP BY key ORDER BY score DESC, key::VARCHAR LIMIT {K}""",
    )(_hybrid)


# ---- sparse semantic retrieval: the coordinates of embeddings are atoms, in whole millionths so that sums are exact

ATOM = "(SELECT vec_id, pos::INTEGER AS atom, round(abs(embedding[pos + 1]::DOUBLE) * 1000000)::BIGINT AS impact FROM (SELECT vec_id, embedding, unnest(range(0, len(embedding))) AS pos FROM embeddings))"


def atoms(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("atom", "x")).select("vec_id", "atom", F.round(F.abs(F.col("x").cast("double")) * 1000000).cast("long").alias("impact"))


@query("sem_encode")
def sem_encode(spark, sf):
    return semantic.encode(table(spark, sf, "documents"), "doc_id", "text", semantic.HashEncoder())


@query("sem_pending")
def sem_pending(spark, sf):
    """Documents whose atoms are still missing are encoded and appended to those that have them."""
    docs = table(spark, sf, "documents")
    done = semantic.encode(docs.filter("doc_id % 3 <> 0"), "doc_id", "text", semantic.HashEncoder())
    pending = docs.join(done.select("doc_id"), "doc_id", "left_anti")
    return done.unionByName(semantic.encode(pending, "doc_id", "text", semantic.HashEncoder())).select("doc_id", F.size("atoms").alias("n_atoms"))


@query("sem_quantize_u8", f"SELECT vec_id, atom, least(255, greatest(1, round(impact / 1000000.0::DOUBLE * 255.0::DOUBLE / 2.0::DOUBLE)::INTEGER)) AS code, round(least(255, greatest(1, round(impact / 1000000.0::DOUBLE * 255.0::DOUBLE / 2.0::DOUBLE)::INTEGER)) * 2.0::DOUBLE / 255.0::DOUBLE, 9) AS decoded FROM {ATOM}")
def sem_quantize_u8(spark, sf):
    code = semantic.quantize_u8(F.col("impact") / 1000000.0)
    return atoms(spark, sf).select("vec_id", "atom", code.alias("code"), F.round(semantic.dequantize_u8(code), 9).alias("decoded"))


@query("sem_alpha_mass", f"SELECT vec_id, atom, impact FROM (SELECT *, sum(impact) OVER (PARTITION BY vec_id) AS total, coalesce(sum(impact) OVER (PARTITION BY vec_id ORDER BY impact DESC, atom ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM {ATOM}) WHERE before < total * 0.8::DOUBLE")
def sem_alpha_mass(spark, sf):
    return semantic.alpha_mass(atoms(spark, sf), ["vec_id"], "impact", "atom", 0.8)


@query("sem_champion_topk", f"WITH a AS {ATOM}, c AS (SELECT DISTINCT vec_id FROM (SELECT *, row_number() OVER (PARTITION BY atom ORDER BY impact DESC, vec_id) AS turn FROM a WHERE atom IN (1, 5, 9)) WHERE turn <= 64) SELECT vec_id, sum(impact)::BIGINT AS score FROM a JOIN c USING (vec_id) WHERE atom IN (1, 5, 9) GROUP BY vec_id ORDER BY score DESC, vec_id LIMIT {K}")
def sem_champion_topk(spark, sf):
    mine = atoms(spark, sf).filter("atom IN (1, 5, 9)")
    seeds = semantic.champions(mine, "atom", "impact", "vec_id").select("vec_id").distinct()
    return mine.join(seeds, "vec_id", "left_semi").groupBy("vec_id").agg(F.sum("impact").alias("score")).orderBy(F.col("score").desc(), "vec_id").limit(K)


@query("sem_unified", f"SELECT doc_id, round(sum(score), 6) AS score FROM (SELECT doc_id, score FROM ({_scored(A)} SELECT doc_id, score FROM sc) UNION ALL SELECT vec_id, impact / 1000000.0::DOUBLE * CASE atom WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE FROM {ATOM} WHERE atom IN (1, 5)) GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT {K}")
def sem_unified(spark, sf):
    lexical = score_rows(documents(spark, sf), F.col("tokens"), A, Bm25()).select("doc_id", F.round("score", 6).alias("score"))
    sem = atoms(spark, sf).filter("atom IN (1, 5)").select(F.col("vec_id").alias("doc_id"), (F.col("impact") / 1000000.0 * F.when(F.col("atom") == 1, 2.0).otherwise(1.0)).alias("score"))
    return top_k(lexical.unionByName(sem).groupBy("doc_id").agg(F.sum("score").alias("score")), "doc_id", K, 6)


@query(
    "sem_calibrate",
    f"""WITH lex AS (SELECT pos::INTEGER AS atom, w FROM (VALUES (0, 2.0::DOUBLE), (3, 1.0::DOUBLE), (7, 1.0::DOUBLE)) t(pos, w)), sem AS (SELECT 64 + atom AS atom, impact / 1000000.0::DOUBLE AS w FROM {ATOM} WHERE vec_id = 0),
rms AS (SELECT atom, round(sqrt(avg((impact / 1000000.0::DOUBLE) * (impact / 1000000.0::DOUBLE))), 6) AS rms FROM (SELECT atom, impact FROM {ATOM} UNION ALL SELECT atom + 64, impact FROM {ATOM}) GROUP BY atom),
s AS (SELECT least(greatest((SELECT sum(w * rms) FROM lex JOIN rms USING (atom)) / (SELECT sum(w * rms) FROM sem JOIN rms USING (atom)) * 1.5::DOUBLE, 0.05::DOUBLE), 2.0::DOUBLE) AS scale)
SELECT atom, round(w, 6) AS weight FROM lex UNION ALL SELECT atom, round(w * scale, 6) FROM sem, s""",
)
def sem_calibrate(spark, sf):
    a = atoms(spark, sf)
    x = F.col("impact") / 1000000.0
    rms = a.select("atom", "impact").unionByName(a.select((F.col("atom") + 64).alias("atom"), "impact")).groupBy("atom").agg(F.round(F.sqrt(F.avg(x * x)), 6).alias("rms"))
    lexical = spark.createDataFrame([(0, 2.0), (3, 1.0), (7, 1.0)], "atom int, weight double")
    sem = a.filter("vec_id = 0").select("atom", x.alias("weight"))
    return semantic.calibrate(lexical, sem, rms, 64, 0.5, 0.1, 4.0, 1.5).select("atom", F.round("weight", 6).alias("weight"))


@query("heavy_hitters", f"SELECT user_id, round(sum(value), 4) AS weight FROM events GROUP BY user_id ORDER BY weight DESC, user_id LIMIT {K}")
def heavy_hitters(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.round(F.sum("value"), 4).alias("weight")).orderBy(F.col("weight").desc(), "user_id").limit(K)


@query(
    "heavy_terms",
    f"WITH {DOCS}, n AS (SELECT term, count(*)::DOUBLE AS weight FROM (SELECT unnest(tokens) AS term FROM d) GROUP BY term) SELECT term, weight FROM n WHERE weight > (SELECT sum(weight) FROM n) * 0.005::DOUBLE",
)
def heavy_terms(spark, sf):
    terms = documents(spark, sf).select(F.explode("tokens").alias("term"), F.lit(1.0).alias("weight"))
    return summary.heavy_hitters(terms, "term", "weight", 0.005)


@query(
    "eval_metrics",
    f"""WITH run AS ({ORACLES["bm25_batch"]}), j AS (SELECT q.item_id AS query_id, doc_id, quality + toxic AS grade FROM labels, benchmark q WHERE quality + toxic > 0 AND doc_id % 10 = q.item_id % 10),
b AS (SELECT query_id, sum(CASE WHEN p <= 10 THEN (power(2.0, grade) - 1) / log2(p + 1) ELSE 0 END) AS idcg, count(*) AS relevant FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, doc_id) AS p FROM j) GROUP BY query_id),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS hits FROM run JOIN j USING (query_id, doc_id)),
p AS (SELECT query_id, sum(CASE WHEN rank <= 10 THEN (power(2.0, grade) - 1) / log2(rank + 1) ELSE 0 END) AS dcg, sum(CASE WHEN rank <= 100 THEN hits::DOUBLE / rank ELSE 0 END) AS ap, min(rank) AS first, sum(CASE WHEN rank <= 100 THEN 1.0::DOUBLE ELSE 0 END) AS in100, count(*)::DOUBLE AS in_run FROM f GROUP BY query_id)
SELECT query_id, round(coalesce(dcg / idcg, 0), 6) AS ndcg10, round(coalesce(ap / least(relevant, 100), 0), 6) AS map100, round(coalesce(CASE WHEN first <= 20 THEN 1.0::DOUBLE / first END, 0), 6) AS mrr20, round(coalesce(in100 / relevant, 0), 6) AS recall100, round(coalesce(in_run / relevant, 0), 6) AS cub FROM b LEFT JOIN p USING (query_id)""",
)
def eval_metrics(spark, sf):
    labels = table(spark, sf, "labels").select("doc_id", (F.col("quality") + F.col("toxic")).alias("grade"))
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), (F.col("item_id") % 10).alias("m"))
    qrels = labels.withColumn("m", F.col("doc_id") % 10).join(q, "m").select("query_id", "doc_id", "grade")
    return evaluate.metrics(bm25_batch(spark, sf), qrels)


# ---- changes: turns of conversations play the log

LOG = "(SELECT conv_id * 1000 + turn AS seq, conv_id % 500 AS doc_id, CASE WHEN turn % 5 = 4 THEN 'delete' ELSE 'upsert' END AS op, text FROM conversations)"
LAST = f"(SELECT doc_id, arg_max(op, seq) AS op, arg_max(text, seq) AS text FROM (SELECT * REPLACE (coalesce(text, '') AS text) FROM {LOG}) GROUP BY doc_id)"
LIVE = f"(SELECT doc_id, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM {LAST}) UNION ALL SELECT doc_id, text FROM {LAST} WHERE op = 'upsert')"
LIVE_DOCS = DOCS.replace("FROM documents", f"FROM {LIVE}")


def log(spark, sf) -> DataFrame:
    seq = F.col("conv_id") * 1000 + F.col("turn")
    return table(spark, sf, "conversations").select(seq.alias("seq"), (F.col("conv_id") % 500).alias("doc_id"), F.when(F.col("turn") % 5 == 4, "delete").otherwise("upsert").alias("op"), F.coalesce("text", F.lit("")).alias("text"))


def base(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text")


@query("delta_upsert", f"SELECT doc_id, op, text FROM {LAST}")
def delta_upsert(spark, sf):
    return mutation.latest(log(spark, sf), "doc_id").select("doc_id", "op", "text")


@query("delta_realtime", _top(_scored(A, docs=LIVE_DOCS)))
def delta_realtime(spark, sf):
    now = mutation.live(base(spark, sf), log(spark, sf), "doc_id")
    return best(score_rows(now.withColumn("tokens", tx.simple_tokens(F.col("text"))), F.col("tokens"), A, Bm25()))


@query("delta_manual", _top(_scored(A)))
def delta_manual(spark, sf):
    old = mutation.live(base(spark, sf), log(spark, sf), "doc_id", "manual")
    return best(score_rows(old.withColumn("tokens", tx.simple_tokens(F.col("text"))), F.col("tokens"), A, Bm25()))


@query("delta_delete", f"SELECT doc_id FROM {LIVE}")
def delta_delete(spark, sf):
    return mutation.live(base(spark, sf), log(spark, sf), "doc_id").select("doc_id")


@query("compact_equivalence", ORACLES["delta_realtime"])
def compact_equivalence(spark, sf):
    """The log folded into a new index generation ranks as the live view does."""
    tokens = tx.simple_tokens(F.col("text"))
    index = Index.build(spark, folder(spark), base(spark, sf), "doc_id", tokens)
    folded = index.refresh(mutation.live(index.table("docs").drop("_dl"), log(spark, sf), "doc_id"), tokens)
    return folded.query(" ".join(A), K).select("doc_id", "score")


@query("delta_stream", f"SELECT doc_id, op, text FROM {LAST}")
def delta_stream(spark, sf):
    """The change log arrives as a stream and is appended to the index's log folder, then read."""
    at = folder(spark)
    log(spark, sf).write.parquet(f"{at}/in")
    schema = spark.read.parquet(f"{at}/in").schema
    mutation.ingest(spark.readStream.schema(schema).parquet(f"{at}/in"), f"{at}/log", f"{at}/commits").awaitTermination()
    return mutation.latest(spark.read.parquet(f"{at}/log"), "doc_id").select("doc_id", "op", "text")


def changed_index(spark, sf) -> Index:
    """An index over documents to whose log the last changes are appended."""
    docs = documents(spark, sf).select("doc_id", "tokens")
    index = Index.build(spark, folder(spark), docs, "doc_id", "tokens")
    last = delta_upsert(spark, sf)
    index.upsert(last.filter("op = 'upsert'").select("doc_id", tx.simple_tokens(F.col("text")).alias("tokens")))
    index.delete(last.filter("op = 'delete'"))
    return index


@query("idx_realtime", ORACLES["delta_realtime"])
def idx_realtime(spark, sf):
    return changed_index(spark, sf).query_tokens(list(A), K).select("doc_id", "score")


@query("idx_maintained", ORACLES["delta_realtime"])
def idx_maintained(spark, sf):
    index = changed_index(spark, sf)
    index.maintain()
    index.reclaim()
    return index.query_tokens(list(A), K).select("doc_id", "score")


@query("idx_stream", ORACLES["delta_realtime"])
def idx_stream(spark, sf):
    """All changes, several of a key, stream into the log of an index in no order, and the last of each by `seq` counts."""
    at = folder(spark)
    index = Index.build(spark, f"{at}/index", documents(spark, sf).select("doc_id", "tokens"), "doc_id", "tokens")
    log(spark, sf).select("doc_id", "op", "seq", tx.simple_tokens(F.col("text")).alias("tokens")).repartition(4).write.parquet(f"{at}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{at}/in").schema).parquet(f"{at}/in")
    mutation.follow(stream, index, f"{at}/commits").awaitTermination()
    return index.query_tokens(list(A), K).select("doc_id", "score")


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return QUERIES["bm25_lucene"](spark, sf)
