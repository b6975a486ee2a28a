"""Queries for lexical retrieval, vectors, ranking and search."""

from pyspark.sql import functions as F

from termweave.catalog import views as V
from termweave.catalog.registry import query
from termweave.catalog.sqlviews import CTES, with_ctes
from termweave.functions import text as X
from termweave.operators import hierarchy as H
from termweave.operators import lexical as L
from termweave.operators import ranking as R
from termweave.operators import semantic as E
from termweave.operators import vector_index as I
from termweave.plans import search as S

# ── lexical ──

_WORDS = r"string_split(trim(regexp_replace(lower({t}), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ')"
_STOP = "[" + ", ".join(f"'{w}'" for w in X.STOP_WORDS) + "]"
_GRAMS = (
    "list_distinct(flatten(list_transform(list_filter(" + _WORDS + ", lambda w: w <> ''), lambda w: "
    "list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
)


def _words(t: str) -> str:
    return f"list_distinct(list_filter({_WORDS.format(t=t)}, lambda w: w <> '' AND NOT list_contains({_STOP}, w)))"


def _grams(t: str) -> str:
    return _GRAMS.format(t=t)


@query(
    "analyze_text",
    with_ctes(extra={"w": f"SELECT doc_id, {_WORDS.format(t='text')} AS ws FROM documents",
                     "t": "SELECT doc_id, unnest(ws) AS token, unnest(range(1, len(ws) + 1)) AS pos FROM w"})
    + f"SELECT doc_id, count(*) AS tokens, count(DISTINCT token) AS distinct_tokens, sum(pos) AS positions FROM t WHERE token <> '' AND NOT list_contains({_STOP}, token) GROUP BY 1",
)
def analyze_text(spark, sf):
    """Unstemmed analysis of whole documents, summed up per document."""
    analysed = L.analyze_text(V.table(spark, sf, "documents").select("doc_id", "text"), stem=False)
    return (
        analysed.select("doc_id", F.explode("entries").alias("e"))
        .groupBy("doc_id")
        .agg(F.count(F.lit(1)).alias("tokens"), F.countDistinct("e.token").alias("distinct_tokens"), F.sum("e.pos").alias("positions"))
    )


@query("analyze_text_stemmed")
def analyze_text_stemmed(spark, sf):
    """Stem frequencies over all documents."""
    analysed = L.analyze_text(V.table(spark, sf, "documents").select("doc_id", "text"))
    return analysed.select(F.explode("entries.token").alias("stem")).groupBy("stem").agg(F.count(F.lit(1)).alias("n"))


@query(
    "trigrams",
    f"SELECT doc_id, len({_grams('text')}) AS n, md5(array_to_string(list_sort({_grams('text')}), ',')) AS digest FROM documents",
)
def trigrams(spark, sf):
    out = L.trigrams(V.table(spark, sf, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.size("trigrams").alias("n"), F.md5(F.array_join(F.sort_array("trigrams"), ",")).alias("digest"))


@query(
    "trgm_similarity",
    with_ctes("part_code", extra={"g": f"""SELECT p_partkey, {_grams("p_name || ' ' || p_type || ' ' || p_brand")} AS a,
      {_grams("p_name || ' ' || p_type || ' size ' || p_size")} AS b FROM part"""})
    + "SELECT p_partkey, round(CAST(len(list_intersect(a, b)) AS DOUBLE) / (len(a) + len(b) - len(list_intersect(a, b))), 6) AS similarity FROM g",
)
def trgm_similarity(spark, sf):
    p = V.table(spark, sf, "part")
    a = X.trigrams(F.concat_ws(" ", "p_name", "p_type", "p_brand"))
    b = X.trigrams(F.concat_ws(" ", "p_name", "p_type", F.lit("size"), F.col("p_size").cast("string")))
    return p.select("p_partkey", F.round(X.trgm_similarity(a, b), 6).alias("similarity"))


def _document_corpus(spark, sf):
    doc = V.table(spark, sf, "documents")
    none = F.lit(None).cast("string")
    return doc.select(
        F.lit(L.CODE_SOURCE).alias("source"), F.col("doc_id").alias("row_id"), F.col("doc_id").alias("concept_id"),
        F.col("doc_id").alias("sort_key"), F.col("doc_id").cast("string").alias("sort_text"),
        F.col("text").alias("a"), none.alias("b"), none.alias("d"),
    )


_DOCUMENT_INDEX = {}


def document_index(spark, sf):
    """Whole documents as a lexical corpus, unstemmed; built once per session."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _DOCUMENT_INDEX:
        index = L.build_postings(_document_corpus(spark, sf), stem=False, similarity=False)
        _DOCUMENT_INDEX[key] = index.materialise()
    return _DOCUMENT_INDEX[key]


def benchmark_queries(spark, sf):
    """Whole benchmark passages as queries."""
    return V.table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("query"))


def _to_documents(pairs, queries, index, *extra):
    """Pairs of text and document keys -> (item_id, doc_id)."""
    ids = queries.select("query_id", F.md5(F.regexp_replace("query", r"^\s+|\s+$", "")).alias("text_id"))
    rows = index.rows.select("source", F.col("doc_id").alias("key"), F.col("row_id"))
    found = pairs.withColumnRenamed("doc_id", "key").join(rows, ["source", "key"]).join(ids, "text_id")
    return found.select(F.col("query_id").cast("bigint").alias("item_id"), F.col("row_id").alias("doc_id"), *extra)


_MATCH = {
    "q": f"SELECT item_id, {_words('text')} AS ws FROM benchmark",
    "qt": "SELECT item_id, len(ws) AS n, unnest(ws) AS token FROM q",
    "dt": f"SELECT doc_id, unnest({_words('text')}) AS token FROM documents",
    "m": "SELECT item_id, doc_id, count(*) = any_value(n) AS all_words FROM qt JOIN dt ON qt.token = dt.token GROUP BY 1, 2",
}


@query("match_all_words", with_ctes(extra=_MATCH) + "SELECT item_id, doc_id FROM m WHERE all_words")
def match_all_words(spark, sf):
    queries, index = benchmark_queries(spark, sf), document_index(spark, sf)
    return _to_documents(L.match_all_words(L.analyze_queries(queries, stem=False), index), queries, index)


@query("match_any_word", with_ctes(extra=_MATCH) + "SELECT item_id, doc_id, all_words FROM m")
def match_any_word(spark, sf):
    queries, index = benchmark_queries(spark, sf), document_index(spark, sf)
    return _to_documents(L.match_any_word(L.analyze_queries(queries, stem=False), index), queries, index, "all_words")


@query(
    "match_fallback",
    with_ctes(extra={**_MATCH, "c": "SELECT item_id, sum(CASE WHEN all_words THEN 1 ELSE 0 END) AS n FROM m GROUP BY 1"})
    + "SELECT m.item_id, doc_id FROM m JOIN c ON c.item_id = m.item_id WHERE c.n < 10 OR all_words",
)
def match_fallback(spark, sf):
    """All-words matches per passage, or any-word matches where fewer than ten documents match."""
    queries, index = benchmark_queries(spark, sf), document_index(spark, sf)

    def run(some, any_word):
        pairs = L.match_any_word(some, index).drop("all_words") if any_word else L.match_all_words(some, index)
        return pairs

    return _to_documents(L.match_fallback(L.analyze_queries(queries, stem=False), run), queries, index)


@query("build_postings")
def build_postings(spark, sf):
    """Postings of the current release: documents per token kind and source."""
    index = V.release(spark, sf).index
    most = index.frequencies.groupBy("kind", "source").agg(F.max("df").alias("most_documents"))
    counted = index.postings.groupBy("kind", "source").agg(F.count(F.lit(1)).alias("postings"), F.countDistinct("token").alias("tokens"))
    return counted.join(F.broadcast(most), ["kind", "source"])  # two kinds of two sources


@query(
    "document_frequencies",
    with_ctes(extra={"dt": _MATCH["dt"]}) + "SELECT token, count(*) AS df FROM dt GROUP BY 1",
)
def document_frequencies(spark, sf):
    """Document frequency of every token over whole documents."""
    # Copies are one document in the index, whose frequencies count the rows it stands for as well.
    return document_index(spark, sf).frequencies.where("kind = 'word'").select("token", F.col("rows").alias("df"))


@query("word_similarity_join")
def word_similarity_join(spark, sf):
    """All similar (query, term text) pairs of the current release."""
    queries, index = V.eval_queries(spark, sf), V.release(spark, sf).index
    found = L.word_similarity_join(L.analyze_queries(queries), index)
    texts = index.documents.select("source", "doc_id", F.col("a").alias("term"))
    ids = queries.select("query_id", F.md5("query").alias("text_id"))
    return found.join(texts, ["source", "doc_id"]).join(ids, "text_id").select("query_id", "source", "term", "similarity")


@query("lexical_rank")
def lexical_rank(spark, sf):
    """Scaled cover density of every benchmark passage in the documents that hold all its words."""
    queries, index = benchmark_queries(spark, sf), document_index(spark, sf)
    texts = L.analyze_queries(queries, stem=False)
    pairs = (
        L.match_all_words(texts, index)
        .join(index.documents.select("source", "doc_id", "entries", "length"), ["source", "doc_id"])
        .join(texts.select("text_id", F.col("tokens").alias("q_tokens")), "text_id")
        .withColumn("total", L.lexical_rank(F.col("entries"), F.col("q_tokens")))
        .withColumn("lexical", F.round(L.scaled_rank(F.col("total")), 9))
        .withColumn("by_length", F.round(L.scaled_rank(F.col("total"), F.col("length")), 9))
        .drop("entries", "q_tokens", "total", "length")
    )
    return _to_documents(pairs, queries, index, "lexical", "by_length")


@query("text_candidates")
def text_candidates(spark, sf):
    return L.text_candidates(V.eval_queries(spark, sf), V.release(spark, sf).index)


@query("text_candidates_any_word")
def text_candidates_any_word(spark, sf):
    return L.text_candidates(V.eval_queries(spark, sf), V.release(spark, sf).index, match="any")


@query("text_candidates_fallback")
def text_candidates_fallback(spark, sf):
    return L.text_candidates(V.eval_queries(spark, sf), V.release(spark, sf).index, match="fallback")


@query(
    "index_length_penalty",
    with_ctes("part_code", extra={"g": f"""SELECT p_partkey, {_grams("p_name || ' ' || p_type || ' ' || p_brand")} AS a,
      {_grams("p_name || ' ' || p_type")} AS b FROM part"""})
    + "SELECT p_partkey, round((1 + CAST(len(list_intersect(a, b)) AS DOUBLE) / (len(a) + len(b) - len(list_intersect(a, b)))) / 2, 6) AS likeness FROM g",
)
def index_length_penalty(spark, sf):
    """A query contained in its index term: containment is 1, the term's extra words lower the mean."""
    p = V.table(spark, sf, "part")
    term = F.concat_ws(" ", "p_name", "p_type", "p_brand")
    query_text = F.concat_ws(" ", "p_name", "p_type")
    contained = X.word_similarity(X.word_text(query_text), X.word_text(term))
    similarity = X.trgm_similarity(X.trigrams(query_text), X.trigrams(term))
    return p.select("p_partkey", F.round(L.index_length_penalty(contained, similarity), 6).alias("likeness"))


# ── vectors ──


@query(
    "embedding_text",
    with_ctes("concept", "synonym")
    + """SELECT c.concept_id, CASE WHEN s.synonym IS NULL OR lower(s.synonym) = lower(c.display) THEN c.display
    ELSE c.display || '. Includes: ' || s.synonym END AS text FROM concept c LEFT JOIN synonym s ON s.concept_id = c.concept_id""",
)
def embedding_text(spark, sf):
    return E.embedding_text(V.concepts(spark, sf), V.synonyms(spark, sf)).select("concept_id", "text")


def _part_rows(spark, sf):
    return V.concepts(spark, sf).where("is_billable").select(
        F.lit("code").alias("source"), F.col("p_partkey").alias("row_id"), "sort_order", F.col("display").alias("text")
    )


def _part_vectors(spark, sf):
    return V.table(spark, sf, "embeddings").select(
        F.lit("code").alias("source"), F.col("vec_id").alias("row_id"), F.lit("m64").alias("model"), "embedding"
    )


@query(
    "pending_rows",
    "SELECT p_partkey AS row_id FROM part WHERE p_partkey NOT IN (SELECT vec_id FROM embeddings)",
)
def pending_rows(spark, sf):
    """Parts without a vector (at the larger scales); with all vectors present, those of another model."""
    rows, have = _part_rows(spark, sf), _part_vectors(spark, sf)
    return E.pending_rows(rows, have, "m64", ["sort_order"]).select("row_id")


@query("done_count", "SELECT 'code' AS source, count(*) AS done FROM part WHERE p_partkey IN (SELECT vec_id FROM embeddings)")
def done_count(spark, sf):
    return E.done_count(_part_rows(spark, sf), _part_vectors(spark, sf), "m64")


@query("embed_batches")
def embed_batches(spark, sf):
    """Vectors of a second model, side by side with the given ones: every part is pending for it."""
    todo = E.pending_rows(_part_rows(spark, sf), _part_vectors(spark, sf), V.MODEL, ["sort_order"])
    made = E.embed_batches(todo, V.MODEL, V.ENCODER, V.DIMENSIONS)
    return made.select("row_id", "model", F.size("embedding").alias("dimensions"), F.round(F.aggregate("embedding", F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double") * x.cast("double")), 4).alias("norm"))


@query(
    "query_instruction",
    with_ctes("eval_query") + f"SELECT query_id, '{V.INSTRUCTION}' || query AS text FROM eval_query",
)
def query_instruction(spark, sf):
    return E.query_instruction(V.eval_queries(spark, sf), V.INSTRUCTION).select("query_id", "text")


@query(
    "check_vectors",
    """SELECT coalesce(p_partkey, vec_id) AS row_id, CASE WHEN vec_id IS NULL THEN 'missing' WHEN p_partkey IS NULL THEN 'not asked for' ELSE 'wrong dimension' END AS problem
    FROM part FULL JOIN embeddings ON vec_id = p_partkey WHERE vec_id IS NULL OR p_partkey IS NULL OR len(embedding) <> 64""",
)
def check_vectors(spark, sf):
    return E.check_vectors(_part_rows(spark, sf), _part_vectors(spark, sf), 64).select("row_id", "problem")


def _vectors(spark, sf):
    v = V.table(spark, sf, "embeddings")
    queries = v.select(F.col("vec_id").alias("query_id"), "embedding")
    corpus = v.select(F.col("vec_id").alias("row_id"), F.col("vec_id").alias("sort_key"), "embedding")
    return queries, corpus


_COSINE = "round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 9)"


@query(
    "knn_topk",
    f"""SELECT query_id, row_id, score, rank FROM (
    SELECT q.vec_id AS query_id, c.vec_id AS row_id, {_COSINE} AS score,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COSINE} DESC, c.vec_id) AS rank FROM embeddings q CROSS JOIN embeddings c) WHERE rank <= 10""",
)
def knn_topk(spark, sf):
    """The ten nearest vectors of every vector."""
    queries, corpus = _vectors(spark, sf)
    return E.knn_topk(queries, corpus, 10).select("query_id", "row_id", "score", "rank")


def _approximate(spark, sf):
    """The search that `ann_topk` runs and `ann_recall` measures."""
    return E.ann_topk(*_vectors(spark, sf), 10)


@query("ann_topk")
def ann_topk(spark, sf):
    return _approximate(spark, sf).select("query_id", "row_id", "score", "rank")


@query("ann_recall")
def ann_recall(spark, sf):
    """Recall of the inverted file against the exact search, and the pairs whose codes it scanned of all."""
    queries, corpus = _vectors(spark, sf)
    search = E.ann_prepare(queries, corpus, 10)
    measured = E.ann_recall(E.knn_topk(queries, corpus, 10), E.ann_topk(queries, corpus, 10, prepared=search))
    scanned = 0
    if search is not None:
        scanned = I.compared_pairs(search.index, I.probed(search.index, queries, search.probes)).first().compared
    vectors = corpus.agg(F.count("embedding").alias("n")).first().n
    return measured.withColumns({"compared": F.lit(scanned).cast("bigint"), "pairs": F.lit(vectors**2).cast("bigint")})


def _stored_vectors(spark, sf):
    """Given vectors as vectors of the leaf codes and of the index terms of the same part."""
    vec = V.table(spark, sf, "embeddings").select(F.col("vec_id"), "embedding")
    order = V.concepts(spark, sf).select("concept_id", "sort_order")
    codes = V.concepts(spark, sf).join(vec, F.col("p_partkey") == F.col("vec_id")).select(
        F.lit(L.CODE_SOURCE).alias("source"), F.col("concept_id").alias("row_id"), "concept_id",
        F.col("sort_order").alias("sort_key"), F.col("code").alias("sort_text"), "embedding",
    )
    terms = V.index_terms(spark, sf).join(vec, F.col("term_id") == F.col("vec_id")).join(order, "concept_id").select(
        F.lit(L.INDEX_SOURCE).alias("source"), F.col("term_id").alias("row_id"), "concept_id",
        F.col("sort_order").alias("sort_key"), F.col("term").alias("sort_text"), "embedding",
    )
    return codes.unionByName(terms)


@query(
    "semantic_candidates",
    with_ctes("concept", "index_term", extra={
        "c": """SELECT 0 AS source, concept_id AS row_id, concept_id, sort_order AS sort_key, CAST(NULL AS VARCHAR) AS matched_on, embedding
                FROM concept JOIN embeddings ON vec_id = p_partkey
                UNION ALL SELECT 1, t.term_id, t.concept_id, k.sort_order, t.term, embedding FROM index_term t
                JOIN concept k ON k.concept_id = t.concept_id JOIN embeddings ON vec_id = t.term_id""",
        "s": f"""SELECT q.vec_id AS query_id, c.concept_id, {_COSINE} AS score, c.matched_on, c.source,
                row_number() OVER (PARTITION BY q.vec_id, c.source ORDER BY {_COSINE} DESC, c.sort_key, c.row_id) AS source_rank
                FROM embeddings q CROSS JOIN c""",
    })
    + "SELECT query_id, concept_id, score, matched_on, source, source_rank FROM s WHERE source_rank <= 200",
)
def semantic_candidates(spark, sf):
    queries, _ = _vectors(spark, sf)
    return E.semantic_candidates(queries, _stored_vectors(spark, sf))


# ── ranking ──

_RANK = {
    "merged": """SELECT r.query_id, r.method, r.concept_id, r.score, r.matched_on, c.code, c.is_billable, c.sort_order FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id, method, concept_id ORDER BY score DESC, source, source_rank) AS pick FROM candidate_row) r
        JOIN concept c ON c.concept_id = r.concept_id WHERE pick = 1""",
    "ranked": """SELECT *, row_number() OVER (PARTITION BY query_id, method ORDER BY round(score, 9) DESC, sort_order, code) AS rank FROM merged""",
    "xr": """SELECT p.prefix AS category, c.concept_id, p.code, p.sort_order,
        CASE WHEN length(replace(p.code, '.', '')) = 7 THEN left(p.code, length(p.code) - 1) ELSE p.code END AS stem
        FROM prefix_all p JOIN concept h ON h.code = p.prefix AND NOT h.is_billable JOIN concept c ON c.code = p.code
        WHERE p.version = '2027' AND p.is_billable""",
    "xf": "SELECT category, stem, min(sort_order) AS first FROM xr GROUP BY 1, 2",
    "xo": "SELECT *, row_number() OVER (PARTITION BY category ORDER BY first) AS n FROM xf",
    "xc": "SELECT category, min(first) AS cut FROM xo WHERE n = 11 GROUP BY 1",
    "expansion": """SELECT xr.*, row_number() OVER (PARTITION BY xr.category ORDER BY xr.sort_order) - 1 AS i
        FROM xr LEFT JOIN xc ON xc.category = xr.category WHERE xc.cut IS NULL OR xr.sort_order < xc.cut""",
    "reached": """SELECT query_id, method, concept_id, code, sort_order, score, matched_on, 1 AS own, rank AS via FROM ranked WHERE is_billable
        UNION ALL SELECT r.query_id, r.method, x.concept_id, x.code, x.sort_order, r.score - 0.0001::DOUBLE * x.i, r.matched_on, 0, r.rank
        FROM ranked r JOIN expansion x ON x.category = r.code WHERE NOT r.is_billable""",
    "expanded": """SELECT * EXCLUDE (pick), row_number() OVER (PARTITION BY query_id, method ORDER BY round(score, 9) DESC, sort_order, code) AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id, method, concept_id ORDER BY score DESC, own DESC, via) AS pick FROM reached) WHERE pick = 1""",
    "family": """SELECT *, CASE WHEN length(replace(code, '.', '')) = 7 THEN left(code, length(code) - 1) ELSE code END AS stem FROM expanded""",
    "head": """SELECT *, row_number() OVER (PARTITION BY query_id, method ORDER BY rank) AS hit_rank FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id, method, stem ORDER BY rank) AS place FROM family) WHERE place = 1""",
    "collapsed": """SELECT h.query_id, h.method, h.hit_rank AS rank, h.concept_id, h.code, h.sort_order, h.score, h.matched_on, h.stem,
        coalesce((SELECT list(f.code ORDER BY f.rank) FROM family f WHERE f.query_id = h.query_id AND f.method = h.method AND f.stem = h.stem AND f.code <> h.code), []) AS variants
        FROM head h""",
}


def _rank(upto: str) -> dict[str, str]:
    return dict(list(_RANK.items())[: list(_RANK).index(upto) + 1])


def _with_rank(upto: str) -> str:
    return with_ctes("candidate_row", "concept", "prefix_all", extra=_rank(upto))


def _method_rows(spark, sf, method):
    return V.candidate_rows(spark, sf).where(F.col("method") == method).drop("method")


def _both(spark, sf, step):
    """A ranking step run per method, the methods told apart by a column."""
    out = None
    for method in ("text", "semantic"):
        one = step(_method_rows(spark, sf, method)).withColumn("method", F.lit(method))
        out = one if out is None else out.unionByName(one)
    return out


@V.stored("expansion")
def _expansion(spark, sf):
    return H.category_expansion(V.concepts(spark, sf))


@query("merge_candidates", _with_rank("ranked") + "SELECT query_id, method, rank, code, round(score, 8) AS score, matched_on FROM ranked")
def merge_candidates(spark, sf):
    out = _both(spark, sf, lambda rows: R.merge_candidates(rows, V.concepts(spark, sf)))
    return out.select("query_id", "method", "rank", "code", F.round("score", 8).alias("score"), "matched_on")


@query("as_hits", _with_rank("ranked") + "SELECT query_id, method, rank, code, '' AS variants FROM ranked")
def as_hits(spark, sf):
    out = _both(spark, sf, lambda rows: R.as_hits(R.merge_candidates(rows, V.concepts(spark, sf))))
    return out.select("query_id", "method", "rank", "code", F.array_join("variants", " ").alias("variants"))


@query("expand_to_billable", _with_rank("expanded") + "SELECT query_id, method, rank, code, round(score, 8) AS score, matched_on FROM expanded")
def expand_to_billable(spark, sf):
    expansion = _expansion(spark, sf)
    out = _both(spark, sf, lambda rows: R.expand_to_billable(R.merge_candidates(rows, V.concepts(spark, sf)), expansion))
    return out.select("query_id", "method", "rank", "code", F.round("score", 8).alias("score"), "matched_on")


def _ranked_lists(spark, sf, method):
    merged = R.merge_candidates(_method_rows(spark, sf, method), V.concepts(spark, sf))
    return R.expand_to_billable(merged, _expansion(spark, sf))


@query("collapse_variants", _with_rank("collapsed") + "SELECT query_id, method, rank, code, array_to_string(variants, ' ') AS variants FROM collapsed")
def collapse_variants(spark, sf):
    out = R.collapse_variants(_ranked_lists(spark, sf, "text")).withColumn("method", F.lit("text")).unionByName(
        R.collapse_variants(_ranked_lists(spark, sf, "semantic")).withColumn("method", F.lit("semantic"))
    )
    return out.select("query_id", "method", "rank", "code", F.array_join("variants", " ").alias("variants"))


def _fused_sql(key: str, source: str, variants: str) -> str:
    return f"""SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, sort_order, code) AS rank FROM (
    SELECT coalesce(t.query_id, s.query_id) AS query_id, coalesce(t.code, s.code) AS code, coalesce(t.sort_order, s.sort_order) AS sort_order,
    CASE WHEN t.code IS NOT NULL THEN t.matched_on ELSE s.matched_on END AS matched_on, t.rank AS text_rank, s.rank AS semantic_rank,
    coalesce(CAST({{tw}} AS DOUBLE) / (60 + t.rank), 0) + coalesce(1.0::DOUBLE / (60 + s.rank), 0) AS score, {variants} AS variants
    FROM (SELECT * FROM {source} WHERE method = 'text') t FULL JOIN (SELECT * FROM {source} WHERE method = 'semantic') s
    ON t.query_id = s.query_id AND t.{key} = s.{key})"""


_UNITED = """CASE WHEN t.code IS NULL THEN s.variants WHEN s.code IS NULL THEN t.variants
    ELSE list_concat(t.variants, list_filter(list_concat([s.code], s.variants), lambda c: c <> t.code AND NOT list_contains(t.variants, c))) END"""


@query(
    "rrf_fuse",
    with_ctes("candidate_row", "concept", "prefix_all", extra={**_rank("collapsed"), "fused": _fused_sql("stem", "collapsed", _UNITED).replace("{tw}", "0.4")})
    + "SELECT query_id, rank, code, round(score, 8) AS score, matched_on, text_rank, semantic_rank, array_to_string(variants, ' ') AS variants FROM fused",
)
def rrf_fuse(spark, sf):
    fused = R.rrf_fuse(
        R.collapse_variants(_ranked_lists(spark, sf, "text")),
        R.collapse_variants(_ranked_lists(spark, sf, "semantic")),
        text_weight=0.4,
    )
    return fused.select(
        "query_id", "rank", "code", F.round("score", 8).alias("score"), "matched_on", "text_rank", "semantic_rank",
        F.array_join("variants", " ").alias("variants"),
    )


@query(
    "rrf_fuse_uncollapsed",
    with_ctes("candidate_row", "concept", "prefix_all", extra={**_rank("expanded"), "fused": _fused_sql("code", "expanded", "''").replace("{tw}", "1.0")})
    + "SELECT query_id, rank, code, round(score, 8) AS score, text_rank, semantic_rank FROM fused",
)
def rrf_fuse_uncollapsed(spark, sf):
    fused = R.rrf_fuse(
        R.as_hits(_ranked_lists(spark, sf, "text")), R.as_hits(_ranked_lists(spark, sf, "semantic")), by_stem=False
    )
    return fused.select("query_id", "rank", "code", F.round("score", 8).alias("score"), "text_rank", "semantic_rank")


# ── search ──


def _shown(hits):
    return hits.withColumn("variants", F.array_join("variants", " "))


@query("rank_method")
def rank_method(spark, sf):
    return _shown(S.rank_method(V.embedded_queries(spark, sf), V.release(spark, sf), "text"))


@query("rank_method_semantic")
def rank_method_semantic(spark, sf):
    return _shown(S.rank_method(V.embedded_queries(spark, sf), V.release(spark, sf), "semantic"))


@query("hybrid_search")
def hybrid_search(spark, sf):
    """Every held-out index term against the current release."""
    return _shown(S.hybrid_search(V.embedded_queries(spark, sf), V.release(spark, sf)))


@query("retrieve")
def retrieve(spark, sf):
    return _shown(S.retrieve(V.embedded_queries(spark, sf), V.release(spark, sf)))


_PREFIX_QUERIES = "SELECT p_partkey AS query_id, CASE WHEN p_size < 25 THEN category ELSE left(code, 6) END AS prefix FROM part_code"


def prefix_queries(spark, sf):
    """Every part asks for its category or for the first part of its code."""
    p = V.part_codes(spark, sf)
    return p.select(
        F.col("p_partkey").alias("query_id"),
        F.when(F.col("p_size") < 25, F.col("category")).otherwise(F.substring("code", 1, 6)).alias("prefix"),
    )


@query(
    "code_prefix_lookup",
    with_ctes("concept", "part_code", "prefix_all", extra={
        "q": _PREFIX_QUERIES,
        "m": """SELECT q.query_id, q.prefix, p.code, count(*) OVER (PARTITION BY q.query_id) AS total,
                row_number() OVER (PARTITION BY q.query_id ORDER BY p.sort_order, p.code) AS rank
                FROM q JOIN prefix_all p ON p.version = '2027' AND p.prefix = q.prefix""",
    })
    + "SELECT query_id, prefix, code, total, rank FROM m WHERE rank > 2 AND rank <= 22",
)
def code_prefix_lookup(spark, sf):
    out = S.code_prefix_lookup(prefix_queries(spark, sf), V.concepts(spark, sf), limit=20, offset=2)
    return out.select("query_id", "prefix", "code", "total", "rank")


@query("search")
def search(spark, sf):
    """Held-out terms and typed codes through the router, hybrid mode."""
    typed = prefix_queries(spark, sf).select(
        F.concat(F.lit("code-"), F.col("query_id").cast("string")).alias("query_id"), F.lower("prefix").alias("query")
    )
    asked = V.eval_queries(spark, sf).select("query_id", "query").unionByName(typed)
    queries = S.embed_queries(asked, V.ENCODER, V.MODEL, V.DIMENSIONS, V.INSTRUCTION)
    return _shown(S.search(queries, V.release(spark, sf)))
