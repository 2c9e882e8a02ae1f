"""Scores, matches and texts of small fixtures with known values."""

import pytest
from pyspark.sql import functions as F

from quillrank.functions import text as tx
from quillrank.functions.porter import stem
from quillrank.operators import fields, filters, fusion
from quillrank.operators.index import Index, policy_recommend
from quillrank.operators.scoring import Bm25, rank, score_rows, top_k
from quillrank.plans.querylang import QueryError, match, parse
from quillrank.streaming import mutation

TOKENS = [(0, ["cat", "cat", "feline"]), (1, ["dog", "friend"]), (2, ["cat", "bird", "bird"]), (3, [])]
SENTENCES = [
    (0, "blue bird flies over the river"),
    (1, "red fox sleeps beside a tree"),
    (2, "blue fox and blue bird share a forest"),
    (3, "postgresql inverted index supports fast lexical search"),
    (4, "semantic retrieval and lexical retrieval cooperate"),
    (5, "bird migration follows the river valley"),
]
PRINTED = 5e-6  # of values known to six digits only
close = lambda want, by=2e-6: pytest.approx(want, rel=by, abs=by)


@pytest.fixture(scope="module")
def tokens(spark):
    return spark.createDataFrame(TOKENS, "doc_id long, tokens array<string>").cache()


@pytest.fixture(scope="module")
def sentences(spark):
    return spark.createDataFrame(SENTENCES, "doc_id long, text string").withColumn("tokens", tx.simple_tokens(F.col("text"))).cache()


def run(docs, q, k=10, params=None, **more):
    got = top_k(rank(docs, F.col("tokens"), q, params, **more).select("doc_id", "score"), "doc_id", k)
    return [(r.doc_id, r.score) for r in got.collect()]


def same(got, want, by=2e-6):
    assert [d for d, _ in got] == [d for d, _ in want]
    assert [s for _, s in got] == close([s for _, s in want], by)


@pytest.mark.parametrize(
    ("q", "want"),
    [
        ("bird cat missing", [(2, 0.8190589), (0, 0.3412417), (1, 0), (3, 0)]),
        ("+cat -bird", [(0, 0.3412417)]),
        ("bi* cat", [(2, 0.8190589), (0, 0.3412417), (1, 0), (3, 0)]),
        ('"cat bird"', [(2, 0.8190589)]),
        ("cat AND bird", [(2, 0.8190589)]),
        ("cat AND NOT bird", [(0, 0.3412417)]),
        ("cat OR bird AND missing", [(2, 0.8190589), (0, 0.3412417)]),
        ('"cat bird" OR (cat AND feline)', [(0, 1.0756173), (2, 1.0453926)]),
    ],
)
def test_raw_queries(tokens, q, want):
    same(run(tokens, q), want)


def test_normalised_query(tokens):
    policy = tx.TextPolicy(stopwords=("and",))
    same(run(tokens, "CAT and BIRD", normalize=tx.normalizer(policy)), [(2, 0.8190589), (0, 0.3412417), (1, 0), (3, 0)])


@pytest.mark.parametrize(
    ("q", "want"),
    [
        ("blue bird river", [(0, 1.1404308), (2, 0.7989012), (5, 0.7138156), (1, 0), (3, 0), (4, 0)]),
        ('"blue bird"', [(2, 0.7989012), (0, 0.7138156)]),
        ("(blue AND bird) OR semantic", [(2, 0.7989012), (0, 0.7138156), (4, 0.6382720)]),
        ("+blue -fox", [(0, 0.4266152)]),
        ("bl*", [(2, 0.5477259), (0, 0.4266152), (1, 0), (3, 0), (4, 0), (5, 0)]),
        ("nowhere", [(i, 0) for i in range(6)]),
    ],
)
def test_sentences(sentences, q, want):
    same(run(sentences, q), want)


def test_after_inserts(spark, sentences):
    more = [(6, "new incremental lexical document"), (7, " ".join(f"l0_unique_{i}" for i in range(1, 2001))), (8, "small inline tail record")]
    docs = sentences.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string")).withColumn("tokens", tx.simple_tokens(F.col("text")))
    same(run(docs, "incremental lexical", 3), [(6, 2.1128290), (4, 0.7473758), (3, 0.7447534)])
    same(run(docs, "l0_unique_1999", 1), [(7, 0.1683706)])


def by_ids(spark, rows, weights, params, **more):
    df = spark.createDataFrame(rows, "doc_id long, ids array<int>").withColumn("tokens", F.col("ids").cast("array<string>"))
    got = score_rows(df, F.col("tokens"), {str(k): v for k, v in weights.items()}, params, **more)
    return [(r.doc_id, r.score) for r in top_k(got.select("doc_id", "score"), "doc_id", 10).collect()]


IDS = [(1, [0, 0, 1]), (2, [1, 2]), (3, [0, 2, 2]), (4, [3])]


def test_ids(spark):
    same(by_ids(spark, IDS, {0: 1, 2: 1}, Bm25("bm25+"))[:3], [(3, 2.895376), (1, 2.098601), (2, 1.880807)])
    same(by_ids(spark, [*IDS, (5, [0, 4])], {0: 1, 2: 1}, Bm25("bm25+"))[:3], [(3, 2.896755), (2, 2.0413523), (1, 1.7824633)])
    same(by_ids(spark, IDS, {0: 1, 2: 1}, Bm25()), [(3, 0.5988481), (1, 0.3577534), (2, 0.2918514), (4, 0)])
    same(by_ids(spark, [(0, [0]), (1, [0]), (2, [0]), (3, [1])], {0: 1}, Bm25())[:2], [(0, 0.14266998), (1, 0.14266998)])
    same(by_ids(spark, [(1, [0]), (2, [0]), (3, [0])], {0: 3}, Bm25("robertson")), [(1, 0), (2, 0), (3, 0)])


def test_weight_mask(spark):
    mask = F.element_at(F.array(F.lit(1.0), F.lit(0.0), F.lit(-1.0), F.lit(1.0)), F.col("doc_id").cast("int"))
    same(by_ids(spark, IDS, {0: 1, 2: 1}, Bm25("bm25+"), mask=mask), [(1, 2.098600), (2, 0.916291), (4, 0.916291), (3, -1.062790)], PRINTED)


MULTI = [(1, ["cat"], ["feline"]), (2, ["bird"], ["cat"]), (3, ["dog"], ["bird", "bird"]), (4, [], ["cat"]), (5, None, ["cat", "bird"]), (6, ["bird"], None)]


def test_fields(spark):
    docs = spark.createDataFrame(MULTI, "doc_id long, title array<string>, body array<string>")
    got = top_k(score_rows(docs, fields.fused(F.col("title"), F.col("body")), {"cat": 1.0, "bird": 1.0}, Bm25()).select("doc_id", "score"), "doc_id", 5).collect()
    same([(r.doc_id, r.score) for r in got], [(2, 0.33957452), (5, 0.33957452), (4, 0.22217876), (6, 0.22217876), (3, 0.2096026)])
    cols = {"title": F.col("title"), "body": F.col("body")}
    got = top_k(fields.rank_fields(docs, cols, "bird", [3.0, 1.0]).select("doc_id", "score"), "doc_id", 6).collect()
    same([(r.doc_id, r.score) for r in got], [(6, 1.553250), (2, 1.186980), (3, 0.488445), (5, 0.395662), (1, 0), (4, 0)], PRINTED)
    with pytest.raises(ValueError, match="field weights must be finite and not negative"):
        fields.rank_fields(docs, cols, "bird", [-1.0, 1.0])
    with pytest.raises(QueryError):
        fields.rank_fields(docs, cols, '"bird cat"')


def test_folded_fields(spark):
    rows = [(1, "Cat", "feline"), (2, "Bird", "cat"), (3, "Dog", "bird bird"), (4, None, "cat"), (5, "Café", "bird"), (6, "bird", None)]
    docs = spark.createDataFrame(rows, "doc_id long, title string, body string")
    policy = tx.TextPolicy(fold_diacritics=True)
    cols = {c: tx.tokenize(F.col(c), policy) for c in ("title", "body")}
    got = top_k(fields.rank_fields(docs, cols, "CAFE bird", [2.0, 1.0], normalize=tx.normalizer(policy)).select("doc_id", "score"), "doc_id", 6).collect()
    same([(r.doc_id, r.score) for r in got], [(5, 1.579580), (6, 1.035500), (2, 0.791323), (3, 0.488445), (1, 0), (4, 0)], PRINTED)


def test_local_overlap(tokens):
    got = tokens.select(tx.overlap(F.col("tokens"), ["cat", "bird"]).alias("n")).collect()
    assert [r.n for r in got] == [1, 0, 2, 0]


def test_match(tokens):
    where = lambda q: [r.doc_id for r in tokens.filter(match(parse(q).root, F.col("tokens"))).orderBy("doc_id").collect()]
    assert where("NOT bird") == [0, 1, 3]
    assert where("bi*") == [2]
    assert where("cat bird") == [0, 2]


PREDICATES = {"blue": {1, 3}, '"blue bird"': {1}, "(blue OR fox)": {1, 2, 3}, "(blue OR fox) AND NOT red": {1, 3}, "NOT blue": {2, 4, 5, 6}, "retriev*": {5}}


def test_predicates(spark):
    rows = [(1, "blue bird flies".split()), (2, "red fox".split()), (3, "blue fox and bird".split()), (4, "index".split()), (5, "semantic retrieval".split()), (6, "river".split())]
    docs = spark.createDataFrame(rows, "id long, tokens array<string>")
    for q, want in PREDICATES.items():
        assert {r.id for r in docs.filter(match(parse(q).root, F.col("tokens"))).collect()} == want, q


@pytest.mark.parametrize("q", ['"open', '""', "*", "(cat", "cat)", "cat +", "-", "+ -cat", "NOT", "cat AND", "( )", " ".join(["x"] * 1025), "(" * 129 + "x" + ")" * 129, "x AND " + "NOT " * 129 + "y"])
def test_malformed(q):
    with pytest.raises(QueryError):
        parse(q)


def test_nesting():
    assert parse("(" * 128 + "x" + ")" * 128).terms == ["x"]
    assert parse("x AND " + "NOT " * 128 + "y").terms == ["x"]


def test_lexing():
    assert parse("and or not").terms == ["and", "or", "not"]  # only upper case is an operator
    assert parse('foo"bar').terms == ['foo"bar']
    assert parse("well-known a+b").terms == ["well-known", "a+b"]
    assert not parse("+a b").simple and parse("a b*").simple and parse("a OR (b OR c)").simple


@pytest.mark.parametrize("bad", [{"b": 1.01}, {"k1": 3.5e38}, {"delta": 3.5e38}, {"k1": float("nan")}, {"b": -0.1}, {"method": "tfidf"}, {"idf_method": "x"}])
def test_parameters(bad):
    with pytest.raises(ValueError):
        Bm25(**bad)


# ---- text


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_text(spark):
    lit = F.lit
    assert one(spark, tx.tokenize(lit("Cat, and dog!"), tx.TextPolicy(stopwords=("and",)))) == ["cat", "dog"]
    assert one(spark, tx.tokenize(lit("Running, runs! THE"), tx.TextPolicy(stopwords=("the",), stem_english=True))) == ["run", "run"]
    assert one(spark, tx.normalize_tokens(F.array(lit("CAFÉ"), lit("Straße"), lit("Über")), tx.TextPolicy(fold_diacritics=True))) == ["cafe", "strasse", "uber"]
    assert one(spark, tx.tokenize(lit("Crème brûlée façade"), tx.TextPolicy(fold_diacritics=True))) == ["creme", "brulee", "facade"]
    assert one(spark, tx.normalize_tokens(F.array().cast("array<string>"))) == []
    assert one(spark, tx.tokenize(lit(None).cast("string"))) == []


def test_python_and_jvm_normalise_alike(spark):
    words = ["CAFÉ", "Straße", "Über", "naïve", "running", "the", "ﬁn", "ΣΊΣΥΦΟΣ", "été"]
    for policy in (tx.TextPolicy(), tx.TextPolicy(fold_diacritics=True, stopwords=("the",)), tx.TextPolicy(stem_english=True), tx.TextPolicy(lowercase=False)):
        mine = [t for w in words for t in tx.normalizer(policy)(w)]
        assert one(spark, tx.normalize_tokens(F.array(*map(F.lit, words)), policy)) == mine


def test_stems():
    known = "caresses:caress ponies:poni ties:ti cats:cat feed:feed agreed:agre plastered:plaster motoring:motor sing:sing conflated:conflat troubled:troubl sized:size hopping:hop falling:fall hissing:hiss failing:fail filing:file happy:happi sky:sky relational:relat conditional:condit rational:ration valenci:valenc digitizer:digit radicalli:radic differentli:differ vileli:vile analogousli:analog vietnamization:vietnam predication:predic operator:oper feudalism:feudal decisiveness:decis hopefulness:hope formaliti:formal sensitiviti:sensit sensibiliti:sensibl triplicate:triplic formative:form formalize:formal electriciti:electr electrical:electr hopeful:hope goodness:good revival:reviv allowance:allow inference:infer airliner:airlin adjustable:adjust defensible:defens irritant:irrit replacement:replac adjustment:adjust dependent:depend adoption:adopt communism:commun activate:activ effective:effect bowdlerize:bowdler probate:probat rate:rate cease:ceas controll:control roll:roll is:is Cats:Cats"
    for pair in known.split():
        word, want = pair.split(":")
        assert stem(word) == want, word


def test_highlights(spark):
    words = F.array(*[F.lit(w) for w in ("cat", "bird", "bird")])
    assert one(spark, tx.highlight(words, ["cat"], ["bi"], start="<mark>", end="</mark>")) == "<mark>cat</mark> <mark>bird</mark> <mark>bird</mark>"
    seven = F.array(*[F.lit(w) for w in "one two cat bird three four five".split()])
    phrase = [["cat", "bird"]]
    assert one(spark, tx.snippet(F.concat(F.array(F.lit("zero")), seven), [], [], phrase, 4, "<mark>", "</mark>")) == "... one two <mark>cat</mark> <mark>bird</mark> ..."
    assert one(spark, tx.plain_terms(F.lit("Cats AND (dogs) -foo_bar"))) == "cats and dogs foo bar"
    assert one(spark, tx.plain_terms(F.lit(" ... "))) is None


# ---- fusion


def cands(spark, *rows):
    return spark.createDataFrame(list(rows), "source_name string, key string, raw_value double, source_rank int, weight double, normalizer string, direction string")


def test_rank_fusion(spark):
    got = fusion.hybrid_fuse(cands(spark, ("title", "1", 4.0, 1, 2.0, "identity", "higher"), ("embedding", "1", 0.4, 2, 1.0, "negative_distance", "lower"), ("embedding", "2", 0.1, 1, 1.0, "negative_distance", "lower")), 3).collect()
    assert [(r.key, r.score, r.source_count, r.source_names, r.ranks) for r in got] == [("1", close(0.048916), 2, ["embedding", "title"], [2, 1]), ("2", close(0.016393), 1, ["embedding"], [1])]


def test_score_fusion(spark):
    both = [("title", "1", 10.0, 1, 2.0, "minmax", "higher"), ("title", "2", 5.0, 2, 2.0, "minmax", "higher"), ("embedding", "1", 0.4, 2, 3.0, "minmax", "lower"), ("embedding", "2", 0.1, 1, 3.0, "minmax", "lower")]
    got = fusion.hybrid_fuse(cands(spark, *both), 2, "score").collect()
    assert [(r.key, r.score, r.weighted_scores) for r in got] == [("2", 3.0, [3.0, 0.0]), ("1", 2.0, [0.0, 2.0])]
    z = fusion.hybrid_fuse(cands(spark, *[("z", str(i), float(i), i, 1.0, "zscore", "higher") for i in (1, 2, 3)]), 3, "score").collect()
    assert [r.key for r in z] == ["3", "2", "1"] and [r.score for r in z] == pytest.approx([1.22474, 0, -1.22474], abs=1e-5)
    mixed = fusion.hybrid_fuse(cands(spark, ("ranked", "1", 99.0, 2, 1.0, "rank", "higher"), ("distance", "1", 0.5, 1, 1.0, "inverse_distance", "lower")), 1, "score").collect()
    assert mixed[0].score == pytest.approx(2.5, abs=1e-5)
    flat = fusion.hybrid_fuse(cands(spark, ("f", "1", 7.0, 1, 1.0, "zscore", "higher"), ("f", "2", 7.0, 2, 1.0, "zscore", "higher"), ("one", "3", 42.0, 1, 1.0, "minmax", "higher")), 3, "score").collect()
    assert [(r.key, r.score) for r in flat] == [("3", 1.0), ("1", 0.0), ("2", 0.0)]


def test_odd_candidates(spark):
    nan, inf = float("nan"), float("inf")
    bad = cands(spark, ("b", "1", nan, 1, 1.0, "identity", "higher"), ("b", "2", inf, 1, 1.0, "identity", "higher"), ("b", "3", -inf, 1, 1.0, "identity", "higher"), ("b", None, 1.0, 1, 1.0, "identity", "higher"), ("b", "4", None, 1, 1.0, "identity", "higher"), ("b", "5", 1.0, -1, 1.0, "identity", "higher"))
    assert fusion.hybrid_fuse(bad, 3, "score").count() == 0
    twice = fusion.hybrid_fuse(cands(spark, ("d", "1", 0.9, 1, 1.0, "rank", "lower"), ("d", "1", 0.1, 1, 1.0, "rank", "lower")), 1, "score").collect()
    assert (twice[0].raw_values, twice[0].ranks) == ([0.1], [1])
    with pytest.raises(ValueError):
        fusion.candidates(spark.range(1), "x", F.col("id"), F.col("id"), normalizer="nope")


def test_pair_fusion(spark, tokens):
    part = lambda q: top_k(rank(tokens, F.col("tokens"), q).select("doc_id", "score"), "doc_id", 3)
    got = fusion.fuse_hits([(part("bird"), 2.0), (part("cat"), 1.0)], 3, digits=7).collect()
    same([(r.doc_id, r.score) for r in got], [(2, 1.4117839), (0, 0.3412417), (1, 0)])


# ---- filters


def test_filters(spark):
    df = spark.createDataFrame([(1, "Alpha", ["x", "Yes"], 1.5), (2, None, [], None), (3, "beta", None, 9.0), (4, "ALPS", ["no", None], 3.0)], "id long, name string, tags array<string>, n double")
    ids = lambda spec: [r.id for r in df.filter(filters.predicate(df, spec)).orderBy("id").collect()]
    assert ids({"name": {"eq": "beta"}}) == [3] and ids({"name": {"eq": None}}) == [2]
    assert ids({"id": {"in": [1, 4, 99]}}) == [1, 4] and ids({"id": {"in": []}}) == []
    assert ids({"tags": {"overlap": ["no", "x"]}}) == [1, 4] and ids({"tags": {"overlap": []}}) == []
    assert ids({"name": {"ilike": "al%"}}) == [1, 4] and ids({"tags": {"ilike_any": ["y_s"]}}) == [1]
    assert ids({"n": {"range": {"gt": 1.5, "lte": 9}}}) == [3, 4] and ids('{"n": {"range": {"gte": 1.5}}, "name": {"ilike": "a%"}}') == [1, 4]
    for bad in ({}, [], {"zz": {"eq": 1}}, {"n": {"near": 1}}, {"n": {"eq": 1, "in": []}}, {"n": {"range": {}}}, {"n": {"range": {"gt": None}}}, {"name": {"overlap": []}}, {"n": {"ilike": "a"}}, {"id": {"in": list(range(4097))}}, {f"c{i}": {"eq": 1} for i in range(33)}):
        with pytest.raises(filters.FilterError):
            filters.predicate(df, bad)


# ---- the persistent index


def test_index_answers_like_the_scan(spark, sentences, tmp_path):
    index = Index.build(spark, str(tmp_path / "i"), sentences.drop("tokens"), "doc_id", "text")
    for q in ("blue bird river", '"blue bird"', "(blue AND bird) OR semantic", "+blue -fox", "bl*", "nowhere", "BLUE Bird"):
        got = [(r.doc_id, r.score) for r in index.query(q, 6).collect()]
        same(got, [(d, round(s, 6)) for d, s in run(sentences, q.lower() if q == "BLUE Bird" else q)])
    again = Index.open(spark, str(tmp_path / "i"))
    assert again.query("blue", 1).first().doc_id == 2
    assert [r.doc_id for r in index.query("bird", 5, filters={"text": {"ilike": "%river%"}}).collect()] == [0, 5]
    assert [r.doc_id for r in index.query("bird", 5, allowed=spark.createDataFrame([(5,), (2,)], "doc_id long")).collect()] == [5, 2]
    with pytest.raises(ValueError):
        index.query("bird", 0)


def test_index_of_stemmed_text(spark, tmp_path):
    docs = spark.createDataFrame([(1, "The runners are running quickly"), (2, "Walking slowly"), (3, "The run was cancelled")], "id long, content string")
    policy = tx.TextPolicy(stopwords=("the", "are", "was"), stem_english=True)
    index = Index.build(spark, str(tmp_path / "s"), docs, "id", "content", policy=policy)
    assert sorted(r.id for r in index.query("the running", 5).collect() if r.score > 0) == [1, 3]


@pytest.mark.parametrize("method", ["bm25l", "bm25+", "robertson", "atire"])
def test_index_variants(spark, sentences, tmp_path, method):
    index = Index.build(spark, str(tmp_path / "v"), sentences.drop("tokens"), "doc_id", "text", params=Bm25(method))
    got = [(r.doc_id, r.score) for r in index.query("blue blue bird forest", 6).collect()]
    same(got, [(d, round(s, 6)) for d, s in run(sentences, "blue blue bird forest", params=Bm25(method))])


def test_changes(spark, tmp_path):
    ids = spark.createDataFrame(IDS, "id long, ids array<int>").select("id", F.col("ids").cast("array<string>").alias("ids"))
    new = spark.createDataFrame([(5, ["0", "4"])], "id long, ids array<string>")
    base = [(3, 2.895376), (1, 2.098601), (2, 1.880807)]
    after = [(3, 2.896755), (2, 2.041352), (1, 1.782463)]
    top = lambda i: [(r.id, r.score) for r in i.query_tokens(["0", "2"], 3).collect()]
    for consistency in ("realtime", "eventual", "manual"):
        index = Index.build(spark, str(tmp_path / consistency), ids, "id", "ids", params=Bm25("bm25+"), consistency=consistency)
        same(top(index), base)
        index.upsert(new)
        same(top(index), base if consistency == "manual" else after)
        assert index.status()["pending"] == 1
        assert index.maintain() == {"acted": True, "reason": "folded", "generation": 2}
        assert index.maintain()["reason"] == "no_pending"
        same(top(Index.open(spark, str(tmp_path / consistency))), after)
        index.delete(new.select("id"))
        index.maintain()
        same(top(index), base)
        index.upsert(new)
        index.delete(new.select("id"))
        same(top(index), base)
        index.drop()


def test_a_late_commit_is_not_lost(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(list(x), "id long, text string")
    mine = Index.build(spark, str(tmp_path / "late"), rows((0, "old words"), (1, "more words")), "id", "text")
    other = Index.open(spark, mine.path)
    mine.upsert(rows((1, "beta words")))
    # another writer has written its rows, commits them only after the fold
    create, held = other.store.create, []
    other.store.create = lambda name, body: held.append((name, body)) or True
    other.upsert(rows((0, "alpha words")))
    mine.maintain()
    other.store.create = create
    (_, body), = held
    assert not other.store.create("_commits/000000000001.json", body)  # that number is taken: the writer takes the next
    other.upsert(rows((0, "alpha words")))
    assert mine.pending() == 1
    assert [r.id for r in Index.open(spark, mine.path).query("+alpha", 3).collect()] == [0]
    mine.maintain()
    assert [r.id for r in mine.query("+alpha", 3).collect()] == [0] and [r.id for r in mine.query("+beta", 3).collect()] == [1]
    fresh = mine.refresh(rows((0, "gamma"), (5, "delta")))
    other.upsert(rows((7, "gamma late")))
    assert sorted(r.id for r in fresh.query("+gamma", 3).collect()) == [0, 7]


def test_concurrent_writers_have_a_number_each(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    index = Index.build(spark, str(tmp_path / "many"), spark.createDataFrame([(0, "start")], "id long, text string"), "id", "text")
    with ThreadPoolExecutor(6) as pool:
        numbers = list(pool.map(lambda i: Index.open(spark, index.path).upsert(spark.createDataFrame([(i, f"word{i}")], "id long, text string")), range(1, 9)))
    assert sorted(numbers) == list(range(1, 9)) and index.pending() == 8
    assert index.maintain()["acted"] and index.manifest["docs"] == 9
    with pytest.raises(OSError, match="published already"):
        Index(spark, index.path, index.manifest | {"generation": 1})._next(index.table("docs").drop("_dl"), ["text"], 8, {})


def test_a_batch_keeps_its_own_order(spark, tmp_path):
    index = Index.build(spark, str(tmp_path / "s"), spark.createDataFrame([(0, "old"), (1, "old")], "id long, text string"), "id", "text")
    changes = spark.createDataFrame([(0, "delete", None, 5), (0, "upsert", "new words", 6), (1, "upsert", "new words", 5), (1, "delete", None, 10), (2, "upsert", "nine", 9), (2, "upsert", "ten", 10), (3, "upsert", "below", -1), (3, "upsert", "above", 0)], "id long, op string, text string, seq long")
    changes.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(changes.schema).parquet(str(tmp_path / "in"))
    mutation.follow(stream, index, str(tmp_path / "cp")).awaitTermination()
    assert sorted((r.id, r.text) for r in index.query("whatever", 9).collect()) == [(0, "new words"), (2, "ten"), (3, "above")]
    assert index.append(changes, "op", "seq", (str(tmp_path / "cp"), 0)) == 0 and len(index._commits()) == 1  # the batch again
    index.maintain()
    assert index.append(changes, "op", "seq", (str(tmp_path / "cp"), 0)) == 0 and index.pending() == 0


def test_reclaim_waits_for_readers(spark, tmp_path):
    index = Index.build(spark, str(tmp_path / "r"), spark.createDataFrame([(0, "one two")], "id long, text string"), "id", "text")
    reader = Index.open(spark, index.path, pin=True)
    index.upsert(spark.createDataFrame([(1, "one")], "id long, text string"))
    assert index.try_maintain()["acted"] and index.reclaim() == 0
    assert sorted(r.id for r in reader.query("+one", 3).collect()) == [0, 1]
    reader.close()
    assert index.reclaim() == 1 and index.store.names("log") == [] and len(index.store.names("_commits")) == 1
    assert index.upsert(spark.createDataFrame([(2, "one")], "id long, text string")) == 2  # numbers go on
    assert index.lock("maintain") and index.try_maintain()["reason"] == "locked"
    index.unlock("maintain")
    assert index.audit().count() == 0 and index.maintain_due()["reason"] == "not_due"


def test_expression_partial_and_scope(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"Alpha w{i % 3}", ["x", "y"][i % 2], [str(i % 3), "z"]) for i in range(12)], "id long, text string, kind string, tags array<string>")
    index = Index.build(spark, str(tmp_path / "e"), docs, "id", expression="concat_ws(' ', text, kind)", where="id <> 4", scope=["kind", "tags"])
    assert [r.id for r in index.query('+"w1 x"', 9).collect()] == [10]
    index.upsert(spark.createDataFrame([(4, "Alpha w1", "x", None), (2, "Alpha w1", "x", ["q"]), (20, "Alpha w1", "x", ["1"])], docs.schema))
    assert [r.id for r in index.query('+"w1 x"', 9).collect()] == [2, 10, 20]
    for spec in ({"kind": {"eq": "x"}}, {"tags": {"overlap": ["1", "9"]}, "kind": {"in": ["x", "y"]}}, {"id": {"range": {"gte": 3}}}, {"kind": {"eq": "nope"}}):
        want = sorted(r.id for r in index._view().rows.filter(filters.predicate(docs, spec)).collect())
        assert sorted(r.id for r in index.members(spec).collect()) == want
        assert sorted(r.id for r in index.query("alpha", 50, filters=spec).collect()) == want
    with pytest.raises(ValueError, match="needs sae"):
        Index.build(spark, str(tmp_path / "o"), docs, "id", "text", options={"model": "m"})
    with pytest.raises(ValueError, match="no option"):
        Index.build(spark, str(tmp_path / "o"), docs, "id", "text", options={"wrong": 1})


def test_index_queries_read_few_rows_of_docs(spark, sentences, tmp_path):
    index = Index.build(spark, str(tmp_path / "p"), sentences.drop("tokens"), "doc_id", "text")
    plan = index.query("blue bird", 2)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(doc_id" in plan and "postings" not in plan


def test_hot_upserts_take_the_last(spark, tmp_path):
    index = Index.build(spark, str(tmp_path / "u"), spark.createDataFrame(SENTENCES, "id long, text string"), "id", "text")
    for word in ("alpha", "beta", "gamma"):
        index.upsert(spark.createDataFrame([(0, f"{word} bird")], "id long, text string"))
    assert [r.id for r in index.query("+beta", 3).collect()] == [] and [r.id for r in index.query("+gamma", 3).collect()] == [0]


def test_policies():
    assert policy_recommend("balanced") == ("realtime", "high") and policy_recommend("write_heavy") == ("eventual", "medium")
    assert policy_recommend("query_first", semantic=True)[0] == "eventual"
    with pytest.raises(ValueError):
        policy_recommend("other")
