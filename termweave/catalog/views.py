"""The given tables seen as terminology and coding data (Spark side).

`catalog.sqlviews` states the same views as SQL for the oracle. Nothing is invented beyond
the mapping: every row comes from a row of the given tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from termweave.functions.codes import ICD10CM_URL
from termweave.operators import semantic
from termweave.operators.hierarchy import derive_parent
from termweave.operators.indexterms import is_holdout
from termweave.plans import search as S
from termweave.session import materialise, numbered

MODEL = "hash-64"
DIMENSIONS = 64
ENCODER = semantic.hashing_encoder(DIMENSIONS)
INSTRUCTION = "find the code whose description means: "
CURRENT, PREVIOUS = "2027", "2026"
HOLDOUT_PERCENT = 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_STORED: dict[tuple[str, str, str], DataFrame] = {}


def stored(name: str):
    """The view is derived once per session and kept as a table in the shared folder."""

    def wrap(build):
        def read(spark: SparkSession, sf_dir: str) -> DataFrame:
            key = (spark.sparkContext.applicationId, sf_dir, name)
            if key not in _STORED:
                _STORED[key] = materialise(build(spark, sf_dir), name)
            return _STORED[key]

        read.__doc__ = build.__doc__
        return read

    return wrap


@stored("part-codes")
def part_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part with its category (letter of the type, two-digit brand) and leaf code."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    types = part.select("p_type").distinct().withColumn("tr", F.row_number().over(W.orderBy("p_type")))
    bn = F.replace(F.col("p_brand"), F.lit("Brand#"), F.lit("")).cast("int")
    seq = F.col("seq")
    step = F.floor(seq / 3).cast("string")
    return (
        numbered(part.join(types, "p_type"), ["p_type", "p_brand"], "p_partkey", "seq")
        .withColumn("bn", bn)
        .withColumn("category", F.concat(F.char(F.col("tr") + 64), F.lpad(F.col("bn").cast("string"), 2, "0")))
        .withColumn("step", F.when(F.length(step) < 3, F.lpad(step, 3, "0")).otherwise(step))
        .withColumn("code", F.concat("category", F.lit("."), "step", F.substring(F.lit("ADS"), seq % 3 + 1, F.lit(1))))
        .withColumn("base_order", (F.col("tr") * 100 + F.col("bn")).cast("bigint") * 10**9)
    )


def concepts(spark: SparkSession, sf_dir: str, version: str | None = CURRENT) -> DataFrame:
    """The concepts of one release, or of both."""
    every = all_concepts(spark, sf_dir)
    return every if version is None else every.where(F.col("version") == version)


@stored("hierarchy")
def hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts of both releases with their parent codes."""
    return derive_parent(all_concepts(spark, sf_dir))


@stored("concepts")
def all_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both releases. The previous one lacks the parts of size above 45."""
    parts = part_codes(spark, sf_dir)
    releases = [(CURRENT, parts), (PREVIOUS, parts.where("p_size <= 45"))]
    out = None
    for name, some in releases:
        tag = int(name) % 100
        leaves = some.select(
            ((F.col("p_partkey") + 1) * 100 + tag).alias("concept_id"), "code",
            F.concat_ws(" ", "p_name", F.lower("p_type"), F.lit("size"), F.col("p_size").cast("string")).alias("display"),
            F.col("p_name").alias("short_display"), F.lit(True).alias("is_billable"),
            (F.col("base_order") + 10 + F.col("seq")).alias("sort_order"),
            F.lit(None).cast("map<string,array<string>>").alias("notes"), "category", "p_partkey",
        )
        level = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))
        headers = (
            some.select("category", "tr", "bn", "p_type", "p_brand", "base_order").distinct()
            .withColumn("level", level)
            .select(
                (-(((F.col("tr") * 100 + F.col("bn")) * 10 + F.col("level")).cast("bigint") * 100 + tag)).alias("concept_id"),
                F.concat("category", F.element_at(F.array(F.lit(""), F.lit(".0"), F.lit(".00")), F.col("level") + 1)).alias("code"),
                F.concat_ws(" ", "p_type", "p_brand").alias("display"),
                F.col("p_brand").alias("short_display"), F.lit(False).alias("is_billable"),
                (F.col("base_order") + F.col("level")).alias("sort_order"),
                F.when(F.col("level") == 0, F.create_map(F.lit("includes"), F.array(F.concat("p_type", F.lit(" goods")))))
                .when(F.col("level") == 2, F.create_map(F.lit("code_also"), F.array(F.lower("p_brand")))).alias("notes"),
                "category", F.lit(None).cast("bigint").alias("p_partkey"),
            )
        )
        release = leaves.unionByName(headers).withColumn("canonical_url", F.lit(ICD10CM_URL)).withColumn("version", F.lit(name))
        out = release if out is None else out.unionByName(release)
    return out


def synonyms(spark: SparkSession, sf_dir: str, version: str = CURRENT) -> DataFrame:
    """The words of a part's name the other way round."""
    named = concepts(spark, sf_dir, version).where("is_billable")
    return named.select(
        "canonical_url", "version", "code", "concept_id",
        F.array_join(F.reverse(F.split("short_display", " ")), " ").alias("synonym"),
    )


def code_systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The releases present in the concept table, each active."""
    return concepts(spark, sf_dir, None).groupBy("canonical_url", "version").agg(
        F.lit("ICD-10-CM").alias("name"), F.max("is_billable").alias("active")
    )


@stored("index-entries")
def index_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index terms before the hold-out: name, type and brand name one category."""
    parts = part_codes(spark, sf_dir)
    depth = (
        F.when(F.split("p_name", " ")[0].isin("blue", "cold", "hot"), 0)
        .when(F.split("p_name", " ")[0].isin("large", "new"), 1)
        .otherwise(2)
    )
    term = F.concat_ws(" ", "p_name", F.lower("p_type"), F.lower("p_brand"))
    return (
        parts.groupBy("p_name", "p_type", "p_brand", "category", "tr", "bn").agg(F.min("p_partkey").alias("term_id"))
        .select("term_id", term.alias("term"), F.col("category").alias("code"), depth.alias("depth"),
                F.lit(False).alias("via_see"), "tr", "bn")
        .withColumn("held_out", is_holdout(F.col("term"), HOLDOUT_PERCENT))
    )


def index_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loaded index terms of the current release."""
    concept = (-(((F.col("tr") * 100 + F.col("bn")) * 10).cast("bigint") * 100 + 27)).alias("concept_id")
    return index_entries(spark, sf_dir).where("not held_out").select(
        F.lit(ICD10CM_URL).alias("canonical_url"), F.lit(CURRENT).alias("version"),
        "term_id", concept, "term", "code", "depth", "via_see",
    )


def eval_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All held-out index terms as queries: query_id, query, gold, depth bucket."""
    bucket = F.when(F.col("depth") == 0, "0").when(F.col("depth") == 1, "1").otherwise("2+")
    return index_entries(spark, sf_dir).where("held_out").select(
        F.concat(F.lit("idx-"), F.col("term_id").cast("string")).alias("query_id"),
        F.col("term").alias("query"), F.array("code").alias("gold"), bucket.alias("depth"),
    )


_RELEASES: dict[tuple[str, str], S.Release] = {}


def release(spark: SparkSession, sf_dir: str) -> S.Release:
    """The searchable current release, written once per session to the shared folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _RELEASES:
        _RELEASES[key] = S.build_release(
            concepts(spark, sf_dir), synonyms(spark, sf_dir), index_terms(spark, sf_dir), ENCODER, MODEL, DIMENSIONS
        ).materialise()
    return _RELEASES[key]


def embedded_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.embed_queries(eval_queries(spark, sf_dir), ENCODER, MODEL, DIMENSIONS, INSTRUCTION)


def candidate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as candidate rows: the order is the query, the part or its category the concept."""
    parts = part_codes(spark, sf_dir).select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_type", "p_brand", "tr", "bn")
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", "l_returnflag", "l_linestatus"
    )
    is_term = F.col("l_linestatus") == "O"
    leaf = (F.col("l_partkey") + 1) * 100 + 27
    header = -(((F.col("tr") * 100 + F.col("bn")) * 10).cast("bigint") * 100 + 27)
    return lines.join(parts, "l_partkey").select(
        F.col("l_orderkey").alias("query_id"),
        F.when(F.col("l_returnflag") == "N", "semantic").otherwise("text").alias("method"),
        F.when(is_term, header).otherwise(leaf).alias("concept_id"),
        (F.col("l_extendedprice") / 100000).alias("score"),
        F.when(is_term, F.concat_ws(" ", "p_name", F.lower("p_type"), F.lower("p_brand"))).alias("matched_on"),
        is_term.cast("int").alias("source"),
        F.col("l_linenumber").alias("source_rank"),
    )
