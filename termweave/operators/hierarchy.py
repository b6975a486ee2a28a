"""Code-system and hierarchy operators (H-05..H-14).

A concept table has one row per (canonical_url, version, code). Descent is a prefix test on the
code; every prefix test here is an equi-join on exploded prefixes, never `startswith`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from termweave.functions.codes import code_prefixes, to_dotted, variant_stem

RELEASE = ["canonical_url", "version"]


def concept_key(*cols: Column) -> Column:
    """Stable surrogate key of a concept or term row."""
    return F.xxhash64(*cols)


def derive_parent(concepts: DataFrame) -> DataFrame:
    """H-05: adds `parent_code`, the longest existing proper prefix in the same release."""
    keys = concepts.select(*RELEASE, "code")
    tried = keys.select(*RELEASE, "code", F.explode(code_prefixes(F.col("code"), proper=True)).alias("parent_code"))
    known = keys.withColumnRenamed("code", "parent_code")
    parents = (
        tried.join(known, [*RELEASE, "parent_code"])
        .groupBy(*RELEASE, "code")
        .agg(F.max_by("parent_code", F.length("parent_code")).alias("parent_code"))
    )
    return concepts.drop("parent_code").join(parents, [*RELEASE, "code"], "left")


def billable_descendants(concepts: DataFrame) -> DataFrame:
    """H-06: (category, child code, sort_order) for every category code and billable descendant."""
    children = concepts.where("is_billable").select(
        *RELEASE,
        F.col("concept_id").alias("child_id"),
        F.col("code").alias("child_code"),
        F.col("sort_order").alias("child_order"),
        F.explode(code_prefixes(F.col("code"))).alias("category"),
    )
    categories = concepts.where("not is_billable").select(*RELEASE, F.col("code").alias("category"))
    return children.join(categories, [*RELEASE, "category"], "left_semi")


def children(concepts: DataFrame) -> DataFrame:
    """H-07: direct children of every concept that has some."""
    parents = concepts.select(*RELEASE, F.col("code").alias("parent_code"))
    return concepts.select(
        *RELEASE, "parent_code", F.col("code").alias("child_code"), F.col("sort_order").alias("child_order")
    ).join(parents, [*RELEASE, "parent_code"], "left_semi")


def ancestors(concepts: DataFrame, codes: DataFrame | None = None) -> DataFrame:
    """(code, ancestor, depth) with the parent at depth 1, however deep the codes are.

    The ancestors of a code are its proper prefixes that exist, so one join gives all of them. `codes` (release, code)
    limits whose ancestors are sought.
    """
    keys = concepts.select(*RELEASE, "code")
    asked = keys if codes is None else keys.join(codes, [*RELEASE, "code"], "left_semi")
    tried = asked.select(*RELEASE, "code", F.explode(code_prefixes(F.col("code"), proper=True)).alias("ancestor"))
    nearest = W.partitionBy(*RELEASE, "code").orderBy(F.desc(F.length("ancestor")))
    return tried.join(keys.withColumnRenamed("code", "ancestor"), [*RELEASE, "ancestor"]).withColumn("depth", F.row_number().over(nearest))


def inherited_notes(concepts: DataFrame, codes: DataFrame | None = None) -> DataFrame:
    """H-08: every ancestor that carries notes, nearest first by `depth`."""
    noted = concepts.where("notes is not null").select(
        *RELEASE, F.col("code").alias("ancestor"), F.col("display").alias("ancestor_display"), "notes"
    )
    return ancestors(concepts, codes).join(noted, [*RELEASE, "ancestor"])


def concept_detail(concepts: DataFrame, synonyms: DataFrame, lookups: DataFrame) -> DataFrame:
    """H-09: one nested record per looked-up code; the input code may be undotted.

    `concepts` has `parent_code`; `synonyms` has (release, code, synonym); `lookups` has
    (release, code). Only the looked-up codes' relatives are gathered.
    """
    wanted = lookups.select(*RELEASE, to_dotted(F.col("code")).alias("code")).distinct()
    summary = F.struct("code", "display", "short_display", "is_billable")
    found = concepts.join(wanted, [*RELEASE, "code"], "left_semi")
    parents = concepts.select(*RELEASE, F.col("code").alias("parent_code"), summary.alias("parent"))
    kids = (
        concepts.where("parent_code is not null")
        .join(wanted.withColumnRenamed("code", "parent_code"), [*RELEASE, "parent_code"], "left_semi")
        .groupBy(*RELEASE, F.col("parent_code").alias("owner"))
        .agg(F.sort_array(F.collect_list(F.struct(F.coalesce("sort_order", F.lit(0)).alias("o"), "code", "display", "short_display", "is_billable"))).alias("kids"))
        .select(*RELEASE, F.col("owner").alias("code"), F.transform("kids", lambda k: k.dropFields("o")).alias("children"))
    )
    names = (
        synonyms.join(wanted, [*RELEASE, "code"], "left_semi")
        .groupBy(*RELEASE, "code")
        .agg(F.sort_array(F.collect_set("synonym")).alias("synonyms"))
    )
    notes = (
        inherited_notes(concepts, wanted)
        .groupBy(*RELEASE, "code")
        .agg(F.array_sort(F.collect_list(F.struct("depth", "ancestor", "ancestor_display", F.to_json("notes").alias("notes")))).alias("inherited"))
    )
    return (
        found.join(parents, [*RELEASE, "parent_code"], "left")
        .join(kids, [*RELEASE, "code"], "left")
        .join(names, [*RELEASE, "code"], "left")
        .join(notes, [*RELEASE, "code"], "left")
        .select(
            *RELEASE, "code", "display", "short_display", "is_billable", "parent", "notes",
            F.coalesce("children", F.array()).alias("children"),
            F.coalesce("synonyms", F.array()).alias("synonyms"),
            F.coalesce("inherited", F.array()).alias("inherited_notes"),
        )
    )


def has_billable(prefixes: DataFrame, concepts: DataFrame, prefix: str = "prefix", within: list[str] | None = None) -> DataFrame:
    """H-10: the rows of `prefixes` under which at least one billable code exists."""
    within = within or []
    reach = (
        concepts.where("is_billable")
        .select(*within, F.explode(code_prefixes(F.col("code"))).alias(prefix))
        .distinct()
    )
    return prefixes.join(reach, [*within, prefix], "left_semi")


def latest_release(code_systems: DataFrame, version: str | None = None) -> DataFrame:
    """H-11: per canonical URL the named version, or the active one with the greatest version string."""
    usable = code_systems.where(F.col("active") if version is None else F.col("version") == version)
    attributes = F.struct(*[c for c in code_systems.columns if c != "canonical_url"])
    return usable.groupBy("canonical_url").agg(F.max_by(attributes, "version").alias("r")).select("canonical_url", "r.*")


def coverage(
    code_systems: DataFrame, concepts: DataFrame, index_terms: DataFrame, embeddings: DataFrame, model: str
) -> DataFrame:
    """H-12: per release the concepts, index terms and how many of each have a vector of `model`."""
    vectors = embeddings.where(F.col("model") == model).select("source", "row_id").distinct()

    def counted(rows: DataFrame, key: str, source: str, total: str, embedded: str) -> DataFrame:
        have = vectors.where(F.col("source") == source).select(F.col("row_id").alias(key), F.lit(1).alias("has"))
        return (
            rows.select(*RELEASE, key).join(have, key, "left").groupBy(*RELEASE)
            .agg(F.count(F.lit(1)).alias(total), F.count("has").alias(embedded))
        )

    codes = counted(concepts, "concept_id", "code", "concept_count", "embedded_count")
    terms = counted(index_terms, "term_id", "index", "index_term_count", "index_terms_embedded")
    counts = ["concept_count", "embedded_count", "index_term_count", "index_terms_embedded"]
    return (
        code_systems.select(*RELEASE, "name")
        .join(codes, RELEASE, "left")
        .join(terms, RELEASE, "left")
        .fillna(0, counts)
        .withColumn("embedded_share", F.when(F.col("concept_count") > 0, F.col("embedded_count") / F.col("concept_count")).otherwise(0.0))
        .orderBy("name", F.desc("version"))
    )


def find_billable(lookups: DataFrame, code_systems: DataFrame, concepts: DataFrame) -> DataFrame:
    """H-13: looked-up codes (any form) that are billable in the latest active release of their system."""
    current = latest_release(code_systems).select(*RELEASE)
    live = concepts.where("is_billable").join(current, RELEASE, "left_semi")
    asked = lookups.withColumn("code", to_dotted(F.col("code")))
    return asked.join(
        live.select("canonical_url", "version", "code", "concept_id", "display"), ["canonical_url", "code"]
    )


def synonyms(tabular: DataFrame, concepts: DataFrame) -> DataFrame:
    """H-14: distinct (release, code, synonym) of codes that exist in the release."""
    return tabular.select(*RELEASE, "code", "synonym").distinct().join(
        concepts.select(*RELEASE, "code", "concept_id"), [*RELEASE, "code"]
    )


def category_expansion(concepts: DataFrame, cap: int = 10) -> DataFrame:
    """The billable descendants a category hit is replaced by (H-06 cut at the stem cap).

    The walk in `sort_order` stops at the first child that would open stem number `cap + 1`.
    Stems are found by a grouped minimum, so no category is ever sorted as a whole.
    """
    reach = billable_descendants(concepts).withColumn("stem", variant_stem(F.col("child_code")))
    position = F.struct(F.coalesce("child_order", F.lit(0)).alias("o"), F.col("child_code").alias("c"))
    stems = reach.groupBy(*RELEASE, "category", "stem").agg(F.min(position).alias("first"))
    by_first = W.partitionBy(*RELEASE, "category").orderBy("first")
    opened = stems.withColumn("n", F.row_number().over(by_first)).where(F.col("n") <= cap + 1)
    everything = W.partitionBy(*RELEASE, "category")
    kept = (
        opened.withColumn("cut", F.max(F.when(F.col("n") == cap + 1, F.col("first"))).over(everything))
        .where(F.col("n") <= cap)
        .select(*RELEASE, "category", "stem", "cut")
    )
    walked = (
        reach.join(kept, [*RELEASE, "category", "stem"])
        .withColumn("at", position)
        .where(F.col("cut").isNull() | (F.col("at") < F.col("cut")))
    )
    i = F.row_number().over(W.partitionBy(*RELEASE, "category").orderBy("at")) - 1
    return walked.withColumn("i", i).select(
        *RELEASE, "category", "child_id", "child_code", "child_order", "stem", "i"
    )
