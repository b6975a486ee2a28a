"""Merging, expansion, collapsing and fusion of candidate lists (R-01..R-05, R-11).

Candidate rows: query_id, concept_id, score, matched_on, source, source_rank. A list is per
query at most two pools long, so the per-query windows below are over small groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from termweave.functions.codes import variant_stem
from termweave.session import rounded, spread

# Fixed values of the ranking rules.
RRF_K = 60
EXPAND_CAP = 10
EXPAND_DECAY = 0.0001

CONCEPT = ["concept_id", "code", "is_billable", "sort_order"]


def _tabular(c: str = "sort_order") -> Column:
    return F.coalesce(F.col(c), F.lit(0))


def _ranked(df: DataFrame) -> DataFrame:
    best_first = W.partitionBy("query_id").orderBy(F.desc(rounded(F.col("score"))), _tabular(), "code")
    return df.withColumn("rank", F.row_number().over(best_first))


def merge_candidates(rows: DataFrame, concepts: DataFrame) -> DataFrame:
    """R-01: one row per (query, concept) with its best score; ties keep the earliest row.

    The rows are placed by query once; the aggregates and windows of this and the following
    steps are keyed by query and something else, so they need no further exchange. The number
    of tasks follows the tables read, so the lists that the later steps widen are sorted in memory.
    """
    earliest = F.struct(F.col("score"), -F.col("source"), -F.col("source_rank"))
    known = spread(rows.join(concepts.select(*CONCEPT), "concept_id"), rows, "query_id")
    best = known.groupBy("query_id", *CONCEPT).agg(F.max_by(F.struct("score", "matched_on"), earliest).alias("b"))
    return _ranked(best.select("query_id", *CONCEPT, "b.*"))


def expand_to_billable(merged: DataFrame, expansion: DataFrame) -> DataFrame:
    """R-02: non-billable candidates give way to their precomputed expansion.

    `expansion`: category, child_id, child_code, child_order, i of one release
    (`category_expansion`). A concept reached several ways keeps its best score; its own hit
    wins a tie, then the better-ranked category. The expansion has a bounded number of rows a
    category, so it is sent to the rows, which stay where they are placed: no wide row is shuffled.
    """
    billable = F.coalesce("is_billable", F.lit(False))
    children = expansion.where("category is not null").select(
        "category", F.struct("child_id", "child_code", "child_order", "i").alias("c")
    )
    itself = F.struct(
        F.col("concept_id").alias("child_id"), F.col("code").alias("child_code"),
        F.col("sort_order").alias("child_order"), F.lit(0).alias("i"),
    )
    rows = (
        merged.withColumn("_of", F.when(~billable, F.col("code")))
        .join(F.broadcast(children), F.col("_of") == F.col("category"), "left")
        .where(billable | F.col("category").isNotNull())
        .withColumn("c", F.when(billable, itself).otherwise(F.col("c")))
        .select(
            "query_id", F.col("c.child_id").alias("concept_id"), F.col("c.child_code").alias("code"),
            F.col("c.child_order").alias("sort_order"), (F.col("score") - EXPAND_DECAY * F.col("c.i")).alias("score"),
            "matched_on", "is_billable", F.col("rank").alias("via"),
        )
    )
    best = F.max_by(F.struct("score", "matched_on"), F.struct(F.col("score"), F.col("is_billable"), -F.col("via")))
    out = (
        rows.groupBy("query_id", "concept_id", "code", "sort_order")
        .agg(best.alias("b"))
        .select("query_id", "concept_id", "code", "sort_order", "b.*", F.lit(True).alias("is_billable"))
    )
    return _ranked(out)


def as_hits(ranked: DataFrame) -> DataFrame:
    """R-04: candidates become hits unchanged."""
    return ranked.withColumn("variants", F.array().cast("array<string>")).select(
        "query_id", "rank", "concept_id", "code", "sort_order", "score", "matched_on", "variants"
    )


def collapse_variants(ranked: DataFrame) -> DataFrame:
    """R-03: one hit per (query, stem): the best-ranked code, the others listed in rank order."""
    member = F.struct("rank", "code", "concept_id", "sort_order", "score", "matched_on")
    families = (
        ranked.withColumn("stem", variant_stem(F.col("code")))
        .groupBy("query_id", "stem")
        .agg(F.sort_array(F.collect_list(member)).alias("m"))
    )
    first = F.col("m")[0]
    others = F.transform(F.slice("m", F.lit(2), F.greatest(F.size("m") - 1, F.lit(0))), lambda x: x["code"])
    hits = families.select(
        "query_id", first["concept_id"].alias("concept_id"), first["code"].alias("code"),
        first["sort_order"].alias("sort_order"), first["score"].alias("score"),
        first["matched_on"].alias("matched_on"), others.alias("variants"), first["rank"].alias("_r"),
    )
    by_rank = W.partitionBy("query_id").orderBy("_r")
    return hits.withColumn("rank", F.row_number().over(by_rank)).select(
        "query_id", "rank", "concept_id", "code", "sort_order", "score", "matched_on", "variants"
    )


def paired_hits(
    text_hits: DataFrame, semantic_hits: DataFrame, by_stem: bool = True, per: tuple[str, ...] = ("query_id",)
) -> DataFrame:
    """First half of R-05: a row per key, (query, stem) or (query, code), with the ranks of both lists, yet unweighed.

    The text hit represents a shared key; the semantic hit's unseen codes join the variants. The lists are stacked
    and folded by key, so lists that are placed by query alike stay where they are; a key that a list repeats meets
    each of the other's.
    """
    key = variant_stem(F.col("code")) if by_stem else F.col("code")
    on = [*per, "key"]

    def side(hits: DataFrame, own: str, other: str) -> DataFrame:
        value = F.struct("rank", "concept_id", "code", "sort_order", "matched_on", "variants")
        none = F.lit(None).cast(hits.select(value.alias("v")).schema["v"].dataType)
        return hits.select(*per, key.alias("key"), value.alias(own), none.alias(other))

    t, s = F.col("t"), F.col("s")
    stacked = side(text_hits, "t", "s").unionByName(side(semantic_hits, "s", "t"))
    # A key with a null is nobody else's.
    apart = F.when(F.greatest(*[F.col(c).isNull() for c in on]), t.isNull().cast("int"))
    both = (
        stacked.groupBy(*on, apart.alias("_apart")).agg(F.collect_list("t").alias("ts"), F.collect_list("s").alias("ss"))
        .select(*per, F.explode_outer("ts").alias("t"), "ss")
        .select(*per, "t", F.explode_outer("ss").alias("s"))
    )
    added = F.filter(
        F.concat(F.array(s["code"]), s["variants"]),
        lambda c: (c != t["code"]) & ~F.array_contains(t["variants"], c),
    )
    variants = (
        F.when(t.isNull(), s["variants"]).when(s.isNull(), t["variants"]).otherwise(F.concat(t["variants"], added))
    )
    return both.select(
        *per,
        *[F.coalesce(t[c], s[c]).alias(c) for c in ("concept_id", "code", "sort_order")],
        F.when(t.isNotNull(), t["matched_on"]).otherwise(s["matched_on"]).alias("matched_on"),
        variants.alias("variants"),
        t["rank"].alias("text_rank"),
        s["rank"].alias("semantic_rank"),
    )


def weigh_pairs(
    pairs: DataFrame,
    text_weight: float | Column = 1.0,
    semantic_weight: float | Column = 1.0,
    per: tuple[str, ...] = ("query_id",),
) -> DataFrame:
    """Second half of R-05: the weighted reciprocal ranks of `paired_hits`, added, and the rank by them."""
    tw = text_weight if isinstance(text_weight, Column) else F.lit(float(text_weight))
    sw = semantic_weight if isinstance(semantic_weight, Column) else F.lit(float(semantic_weight))
    text_part = F.coalesce(tw / (RRF_K + F.col("text_rank")), F.lit(0.0))
    semantic_part = F.coalesce(sw / (RRF_K + F.col("semantic_rank")), F.lit(0.0))
    best_first = W.partitionBy(*per).orderBy(F.desc(F.round("score", 12)), _tabular(), "code")
    return pairs.withColumn("score", text_part + semantic_part).withColumn("rank", F.row_number().over(best_first))


def rrf_fuse(
    text_hits: DataFrame,
    semantic_hits: DataFrame,
    by_stem: bool = True,
    text_weight: float | Column = 1.0,
    semantic_weight: float | Column = 1.0,
    per: tuple[str, ...] = ("query_id",),
) -> DataFrame:
    """R-05: weighted reciprocal rank fusion on (query, stem), or (query, code) when uncollapsed."""
    return weigh_pairs(paired_hits(text_hits, semantic_hits, by_stem, per), text_weight, semantic_weight, per)


def filter_candidates(candidates: DataFrame, needle: str, by_probability: bool = False) -> DataFrame:
    """R-11: case-insensitive substring over code, description or matched_on; unscored rows last."""
    f = needle.strip().lower()
    fits = F.lit(f == "")
    for c in ("code", "display", "matched_on"):
        fits = fits | F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(f))
    order = [F.asc_nulls_last("probability_rank"), F.asc("search_rank")] if by_probability else [F.asc("search_rank")]
    return candidates.where(fits).orderBy("item_id", *order)
