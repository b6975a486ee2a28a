import itertools

from pyspark.sql import functions as F

from termweave.functions import text as X
from termweave.functions.stem import porter
from termweave.operators import lexical as L
from termweave.session import width

WORDS = "acute chronic fracture femur left right open wound scalp size 11 12 infection renal".split()


def corpus(spark):
    texts = [" ".join(p) for p in itertools.islice(itertools.permutations(WORDS, 3), 0, 2000, 17)]
    texts += texts[:20]  # copies
    rows = [(i % 2, i, i, i, f"t{i}", t, None, None) for i, t in enumerate(texts)]
    return spark.createDataFrame(
        rows, "source int, row_id long, concept_id long, sort_key long, sort_text string, a string, b string, d string")


def queries(spark):
    texts = ["acute fracture femur", "femur left", "opne wound", "size 11", "the of", "renal infection chronic acute", "zzz"]
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "query_id string, query string")


def brute_similarity(query, text):
    def seq(t):
        return [f"  {w} "[i:i + 3] for w in t.split() for i in range(len(w) + 1)]

    q, s = set(seq(query)), seq(text)
    return max((len(q & set(s[i:j])) / len(q | set(s[i:j])) for i in range(len(s)) for j in range(i + 1, len(s) + 1)), default=0.0)


def test_porter_examples():
    for word, stem in {"caresses": "caress", "ponies": "poni", "relational": "relat", "hopping": "hop", "falling": "fall",
                       "adjustment": "adjust", "oscillators": "oscil", "rate": "rate", "agreed": "agre"}.items():
        assert porter(word) == stem


def test_best_extent_is_the_greatest_over_all_extents():
    for a, b in itertools.product(["acute fracture", "femur", "size 11 left", "aaa aaaa"], ["left femur fracture acute", "sizes 11 12", "aaaaaa"]):
        assert abs(X.best_extent(a, b) - brute_similarity(a, b)) < 1e-12
    assert X.best_extent("word", "two words") == 0.8


def test_trigrams_and_similarity(spark):
    row = spark.createDataFrame([("Two words",)], "t string").select(
        X.trigrams(F.col("t")).alias("g"), X.trgm_similarity(X.trigrams(F.lit("word")), X.trigrams(F.col("t"))).alias("s")).first()
    assert row.g == ["  t", " tw", "two", "wo ", "  w", " wo", "wor", "ord", "rds", "ds "]
    assert abs(row.s - 4 / 11) < 1e-12


def test_word_similarity_join_equals_brute_force(spark):
    rows, asked = corpus(spark), queries(spark)
    index = L.build_postings(rows)
    found = L.word_similarity_join(L.analyze_queries(asked), index)
    texts = index.documents.select("source", "doc_id", "a")
    got = {
        (r.text_id, r.source, r.a): r.similarity
        for r in found.join(texts, ["source", "doc_id"]).collect()
    }
    want = {}
    ids = {r.query: r.text_id for r in L.analyze_queries(asked).select("query", "text_id").collect()}
    for query, text_id in ids.items():
        for source, text in {(r.source, r.a) for r in rows.collect()}:
            s = round(brute_similarity(query, text), 9)
            if s >= 0.6:
                want[(text_id, source, text)] = s
    assert got == want and want


def test_all_words_equals_brute_force(spark):
    rows, asked = corpus(spark), queries(spark)
    index = L.build_postings(rows, stem=False)
    analysed = L.analyze_queries(asked, stem=False)
    got = {(r.query, r.source, r.a) for r in L.match_all_words(analysed, index).join(index.documents, ["source", "doc_id"]).join(analysed.select("text_id", "query"), "text_id").collect()}
    texts = {(r.source, r.a) for r in rows.collect()}
    want = set()
    for r in asked.collect():
        need = {w for w in r.query.split() if w not in X.STOP_WORDS}
        want |= {(r.query, s, t) for s, t in texts if need and need <= set(t.split())}
    assert got == want and want


def test_candidates_keep_copies_and_fill_the_pool(spark):
    rows, asked = corpus(spark), queries(spark)
    index = L.build_postings(rows)
    got = L.text_candidates(asked, index, pool=5)
    per = got.groupBy("query_id", "source").agg(F.count(F.lit(1)).alias("n"), F.max("source_rank").alias("r"), F.countDistinct("source_rank").alias("d"))
    assert all(r.n <= 5 and r.n == r.r == r.d for r in per.collect())
    full = L.text_candidates(asked, L.build_postings(rows), pool=200)
    best = {(r.query_id, r.source, r.source_rank): (r.concept_id, r.score) for r in full.where("source_rank <= 5").collect()}
    assert {(r.query_id, r.source, r.source_rank): (r.concept_id, r.score) for r in got.collect()} == best


def test_salted_hot_tokens_change_nothing(spark, monkeypatch):
    rows, asked = corpus(spark), queries(spark)
    plain = {tuple(r) for r in L.text_candidates(asked, L.build_postings(rows)).collect()}
    monkeypatch.setattr(L, "HOT_ROWS", 7)
    salted = L.build_postings(rows)
    assert salted.frequencies.agg(F.max("salts")).first()[0] > 1
    assert {tuple(r) for r in L.text_candidates(asked, salted).collect()} == plain


def test_postings_stay_where_their_documents_are(spark):
    """No shuffle behind the written documents, and few keys leave the postings in place; frequencies count copies as rows."""
    rows, asked = corpus(spark), queries(spark)
    index = L.build_postings(rows.unionByName(rows)).materialise()
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan(L.build_postings(rows).postings)
    keys = L.analyze_queries(asked).select(F.lit(L.CODE_SOURCE).alias("source"), F.explode("tokens").alias("token"), F.lit(1).alias("salts"))
    assert "hashpartitioning" not in plan(L._probe(keys, index.postings, "word"))
    held = index.documents.select(*L.DOC, F.explode("tokens").alias("token")).join(index.rows, L.DOC)
    want = {tuple(r) for r in held.groupBy("source", "token").agg(F.countDistinct("doc_id"), F.count(F.lit(1))).collect()}
    assert {tuple(r) for r in index.frequencies.where("kind = 'word'").select("source", "token", "df", "rows").collect()} == want


def test_match_modes(spark):
    rows, asked = corpus(spark), queries(spark)
    index = L.build_postings(rows)
    strict = L.text_candidates(asked, index)
    loose = L.text_candidates(asked, index, match="any")
    fallback = L.text_candidates(asked, index, match="fallback")
    n = lambda df: {r.query_id: r["count"] for r in df.groupBy("query_id").count().collect()}
    s, a, f = n(strict), n(loose), n(fallback)
    for q in f:
        assert f[q] == (s[q] if s.get(q, 0) >= L.FALLBACK_MIN else a[q])


def test_rank_contract(spark):
    def rank(tokens, entries, any_word=False):
        df = spark.createDataFrame([(tokens, entries)], "q array<string>, e array<struct<token:string,pos:int,weight:double>>")
        return df.select(L.scaled_rank(L.lexical_rank(F.col("e"), F.col("q"), any_word))).first()[0]

    near = rank(["a", "b"], [("a", 1, 1.0), ("b", 2, 1.0)])
    far = rank(["a", "b"], [("a", 1, 1.0), ("c", 2, 1.0), ("b", 5, 1.0)])
    light = rank(["a", "b"], [("a", 1, 0.1), ("b", 2, 0.1)])
    twice = rank(["a", "b"], [("a", 1, 1.0), ("b", 2, 1.0), ("a", 9, 1.0), ("b", 10, 1.0)])
    assert rank(["a", "b"], [("a", 1, 1.0)]) == 0.0
    assert 0 < light < near < 1 and far < near < twice < 1
    assert abs(near - 0.5) < 1e-12 and rank(["a", "b"], [("a", 1, 1.0)], True) > 0


def test_plans_have_no_nested_loop(spark):
    index, asked = L.build_postings(corpus(spark)), queries(spark)
    for match in ("all", "any"):
        plan = L.text_candidates(asked, index, match=match)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_pool_is_cut_before_the_shuffle(spark):
    plan = L.text_candidates(queries(spark), L.build_postings(corpus(spark)))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_every_copy_of_a_text_is_a_match(spark):
    rows = spark.createDataFrame(
        [(0, i, i, i, f"{i:05}", "copper lantern copper", "", "") for i in range(300)],
        "source int, row_id long, concept_id long, sort_key long, sort_text string, a string, b string, d string")
    index = L.build_postings(rows, stem=False)
    asked = spark.createDataFrame([("q", "lantern")], "query_id string, query string")
    matched = L.match_all_words(L.analyze_queries(asked, stem=False), index).join(index.rows, ["source", "doc_id"])
    assert matched.count() == 300
    assert L.text_candidates(asked, index, pool=500, stem=False).count() == 300
    assert L.text_candidates(asked, index, pool=7, stem=False).count() == 7
    assert index.documents.first().length == 3  # a repeated word counts


def test_stems_of_word_arrays(spark):
    """Every word of a batch is stemmed in its place; empty and missing arrays stay what they are."""
    lists = [["running", "cities", "running"], [], None, ["a", "hoping"], ["cities"]]
    table = spark.createDataFrame([(i, ws) for i, ws in enumerate(lists)], "i int, ws array<string>").coalesce(1)
    got = dict(table.select("i", X.stem_words("ws")).collect())
    assert got == {i: None if ws is None else [porter(w) for w in ws] for i, ws in enumerate(lists)}


def test_shared_candidates_are_those_of_each_setting(spark, monkeypatch):
    """F4. Pairs are found and measured once, whatever the settings; few bytes of postings are dealt over as many files as tasks."""
    rows, asked = corpus(spark), queries(spark)
    index = L.build_postings(rows).materialise()
    wanted = {
        (pool, match, penalty, terms): sorted(map(repr, L.text_candidates(asked, index, pool, match, penalty, terms).collect()))
        for pool, match, penalty, terms in [(200, "all", False, False), (20, "fallback", True, True)]
    }
    calls = []
    measure = L.measure_pairs
    monkeypatch.setattr(L, "measure_pairs", lambda *a: calls.append(a) or measure(*a))
    shared = L.SharedCandidates(asked, index, True)
    got = {key: sorted(map(repr, shared.rows(*key).collect())) for key in wanted}
    assert got == wanted and len(calls) == 1
    assert any(got.values())
    assert len(index.postings.where("kind = 'word'").inputFiles()) >= width(spark)
