"""Search as one lineage over a table of queries (R-06..R-10).

A `Release` bundles the tables of one code-system release. Everything after candidate
generation is keyed by query_id.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from termweave.functions.codes import code_prefixes, is_code_like, strip, to_dotted
from termweave.operators import lexical, ranking, semantic
from termweave.operators.hierarchy import category_expansion
from termweave.session import materialise

RETRIEVE_LIMIT = 100


@dataclass(frozen=True)
class Release:
    """One release: concepts, its category expansion, the lexical index and one model's vectors."""

    concepts: DataFrame
    expansion: DataFrame
    index: lexical.LexicalIndex
    vectors: DataFrame

    def materialise(self) -> Release:
        return Release(
            materialise(self.concepts, "concepts"),
            materialise(self.expansion, "expansion"),
            self.index.materialise(),
            materialise(self.vectors, "vectors"),
        )


@dataclass(frozen=True)
class SearchOptions:
    """Defaults of the search."""

    use_index_terms: bool = True
    collapse_variants: bool = True
    pool: int = lexical.POOL
    text_match: str = "all"
    length_penalty: bool = True
    text_weight: float = 1.0
    billable_only: bool = True
    topk: Callable[..., DataFrame] = semantic.knn_topk

    def but(self, **changes) -> SearchOptions:
        return replace(self, **changes)


def corpus_rows(concepts: DataFrame, synonyms: DataFrame, index_terms: DataFrame) -> DataFrame:
    """The rows lexical search runs over: codes (display, synonyms, short text) and index terms."""
    names = synonyms.groupBy("concept_id").agg(F.array_join(F.sort_array(F.collect_set("synonym")), " ").alias("b"))
    order = concepts.select("concept_id", F.coalesce("sort_order", F.lit(0)).cast("bigint").alias("sort_key"))
    codes = concepts.join(names, "concept_id", "left").select(
        F.lit(lexical.CODE_SOURCE).alias("source"), F.col("concept_id").alias("row_id"), "concept_id",
        F.coalesce("sort_order", F.lit(0)).cast("bigint").alias("sort_key"), F.col("code").alias("sort_text"),
        F.col("display").alias("a"), "b", F.col("short_display").alias("d"),
    )
    terms = index_terms.join(order, "concept_id").select(
        F.lit(lexical.INDEX_SOURCE).alias("source"), F.col("term_id").alias("row_id"), "concept_id", "sort_key",
        F.col("term").alias("sort_text"), F.col("term").alias("a"),
        F.lit(None).cast("string").alias("b"), F.lit(None).cast("string").alias("d"),
    )
    return codes.unionByName(terms)


def build_release(
    concepts: DataFrame,
    synonyms: DataFrame,
    index_terms: DataFrame,
    encoder_factory: Callable[[], semantic.Encoder],
    model: str,
    dimensions: int,
    stem: bool = True,
) -> Release:
    """Everything search needs from the concept, synonym and index-term tables of one release."""
    corpus = corpus_rows(concepts, synonyms, index_terms)
    texts = (
        semantic.embedding_text(concepts, synonyms)
        .select(F.lit(lexical.CODE_SOURCE).alias("source"), F.col("concept_id").alias("row_id"), "text")
        .unionByName(
            index_terms.select(
                F.lit(lexical.INDEX_SOURCE).alias("source"), F.col("term_id").alias("row_id"), F.col("term").alias("text")
            )
        )
    )
    vectors = semantic.embed_batches(texts, model, encoder_factory, dimensions)
    return Release(
        concepts,
        category_expansion(concepts, ranking.EXPAND_CAP),
        lexical.build_postings(corpus, stem=stem),
        corpus.select("source", "row_id", "concept_id", "sort_key", "sort_text").join(vectors, ["source", "row_id"]),
    )


def embed_queries(
    queries: DataFrame, encoder_factory: Callable[[], semantic.Encoder], model: str, dimensions: int, instruction: str = "",
    isolate: bool = False,
) -> DataFrame:
    """Adds `embedding` to (query_id, query); a text asked many times is encoded once.

    With `isolate` a query that the encoder fails on has no vector but an `error`, and the others are not affected.

    The result is written, because searches read it several times and count it to size their blocks.
    """
    texts = semantic.query_instruction(queries.select("query").distinct(), instruction)
    todo = texts.select(F.lit(-1).alias("source"), F.col("query").alias("row_id"), "text")
    vectors = semantic.embed_batches(todo, model, encoder_factory, dimensions, isolate=isolate)
    found = vectors.select(F.col("row_id").alias("query"), "embedding", *["error"] * isolate)
    return materialise(queries.join(found, "query"), "embedded-queries")


def rank_candidates(rows: DataFrame, release: Release, options: SearchOptions) -> DataFrame:
    """merge -> expand (billable only) -> collapse, or hits as they are."""
    ranked = ranking.merge_candidates(rows, release.concepts)
    if options.billable_only:
        ranked = ranking.expand_to_billable(ranked, release.expansion)
    return ranking.collapse_variants(ranked) if options.collapse_variants else ranking.as_hits(ranked)


def rank_method(queries: DataFrame, release: Release, method: str, options: SearchOptions = SearchOptions()) -> DataFrame:
    """R-06: the final ranking of one method, `text` or `semantic`."""
    if method == "text":
        rows = lexical.text_candidates(
            queries, release.index, options.pool, options.text_match, options.length_penalty, options.use_index_terms
        )
    elif method == "semantic":
        rows = semantic.semantic_candidates(
            queries, release.vectors, options.pool, options.use_index_terms, options.topk
        )
    else:
        raise ValueError(f"unknown method {method!r}")
    return rank_candidates(rows, release, options)


def hybrid_search(queries: DataFrame, release: Release, options: SearchOptions = SearchOptions()) -> DataFrame:
    """R-07: both methods, fused by reciprocal rank."""
    return ranking.rrf_fuse(
        rank_method(queries, release, "text", options),
        rank_method(queries, release, "semantic", options),
        by_stem=options.collapse_variants,
        text_weight=options.text_weight,
    )


def retrieve(
    queries: DataFrame, release: Release, limit: int = RETRIEVE_LIMIT, options: SearchOptions = SearchOptions()
) -> DataFrame:
    """R-08: the top `limit` billable hits of hybrid search with their concept records."""
    hits = hybrid_search(queries, release, options.but(billable_only=True)).where(F.col("rank") <= limit)
    return hits.join(release.concepts.select("concept_id", "display", "short_display"), "concept_id")


def code_prefix_lookup(
    queries: DataFrame, concepts: DataFrame, billable_only: bool = False, limit: int = 20, offset: int = 0
) -> DataFrame:
    """R-09: (query_id, prefix) -> codes starting with the dotted prefix, one page in tabular order.

    `total` is exact: it is counted from the codes under each prefix, not from the page.
    """
    pool = concepts.where("is_billable") if billable_only else concepts
    reach = pool.select(
        "concept_id", "code", "display", "is_billable", "sort_order", F.explode(code_prefixes(F.col("code"))).alias("prefix")
    )
    asked = queries.select("prefix").distinct()
    under = reach.join(asked, "prefix", "left_semi")
    totals = under.groupBy("prefix").agg(F.count(F.lit(1)).alias("total"))
    order = W.partitionBy("prefix").orderBy(F.coalesce("sort_order", F.lit(0)), "code")
    page = (
        under.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= offset + limit)
        .where(F.col("rank") > offset)
    )
    return queries.select("query_id", "prefix").join(totals, "prefix").join(page, "prefix")


def search(
    queries: DataFrame,
    release: Release,
    mode: str = "hybrid",
    options: SearchOptions = SearchOptions(),
    limit: int = 20,
    offset: int = 0,
    codes_are_searchable: bool = True,
) -> DataFrame:
    """R-10: code-shaped queries that match a code become prefix lookups, the rest a ranked search.

    `queries`: query_id, query, embedding (the last one unused in text mode).
    """
    if mode not in ("text", "semantic", "hybrid"):
        raise ValueError(f"unknown mode {mode!r}")
    shaped = (
        queries.where(is_code_like(F.col("query")) & F.lit(codes_are_searchable))
        .select("query_id", to_dotted(F.col("query")).alias("prefix"))
    )
    # "K35." and "K35" both look up K35; the prefix of a code-like query has at least 3 characters.
    by_code = code_prefix_lookup(shaped, release.concepts, options.billable_only, limit, offset)
    pool = release.concepts.where("is_billable") if options.billable_only else release.concepts
    found = pool.select(F.explode(code_prefixes(F.col("code"))).alias("prefix")).distinct()
    looked_up = shaped.join(found, "prefix", "left_semi").select("query_id")
    rest = queries.withColumn("query", strip(F.col("query"))).join(looked_up, "query_id", "left_anti")

    if mode == "hybrid":
        hits, digits = hybrid_search(rest, release, options), 5
    else:
        hits, digits = rank_method(rest, release, mode, options), 4
        hits = hits.withColumn("text_rank", F.lit(None).cast("int")).withColumn("semantic_rank", F.lit(None).cast("int"))
    concepts = release.concepts.select("concept_id", "display", "is_billable")
    page = (
        hits.where((F.col("rank") > offset) & (F.col("rank") <= offset + limit))
        .join(concepts, "concept_id")
        .select(
            "query_id", F.lit(mode).alias("match_type"), "rank", "code", "display", "is_billable",
            F.round("score", digits).alias("score"), "matched_on", "variants", "text_rank", "semantic_rank",
            F.lit(None).cast("bigint").alias("total"),
        )
    )
    codes = by_code.select(
        "query_id", F.lit("code").alias("match_type"), "rank", "code", "display", "is_billable",
        F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("matched_on"),
        F.array().cast("array<string>").alias("variants"),
        F.lit(None).cast("int").alias("text_rank"), F.lit(None).cast("int").alias("semantic_rank"), "total",
    )
    return codes.unionByName(page)
