"""Index-term pipeline (IX-02..IX-06): nodes of the index tree -> searchable terms.

Nodes: path array<string>, depth, code, see, ordinal (document order). `by` names the columns that tell releases apart in
one table, such as ("version",): aliases, references and codes then meet only inside their release.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from termweave.functions.codes import code_prefix, norm_text, strip

MAX_ALIASES = 32


def _has(c: str) -> Column:
    return F.length(F.coalesce(F.col(c), F.lit(""))) > 0


def direct_terms(nodes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """IX-02: nodes with a code of their own."""
    return nodes.where(_has("code")).select(
        *by,
        F.array_join("path", " ").alias("term"), code_prefix(F.col("code")).alias("code"), "depth",
        F.lit(False).alias("via_see"), "ordinal",
    )


def path_aliases(nodes: DataFrame, cap: int = MAX_ALIASES, by: Sequence[str] = ()) -> DataFrame:
    """IX-03: (alias_key, code) of every way to name a coded path; the first in document order wins.

    A title offers itself and each of its comma-separated parts. The combinations are built
    level by level and cut to `cap` at each level, which is part of the rule.
    """

    def variants(title: Column) -> Column:
        parts = F.filter(F.transform(F.split(title, ","), strip), lambda v: F.length(v) > 0)
        return F.concat(F.array(title), parts)

    def extend(aliases: Column, title: Column) -> Column:
        longer = F.flatten(
            F.transform(aliases, lambda a: F.transform(variants(title), lambda v: F.concat_ws(" ", a, v)))
        )
        return F.slice(longer, 1, cap)

    def first_level(title: Column) -> Column:
        return F.slice(variants(title), 1, cap)

    rest = F.slice("path", F.lit(2), F.greatest(F.size("path") - 1, F.lit(0)))
    aliases = F.aggregate(rest, first_level(F.col("path")[0]), extend)
    coded = nodes.where(_has("code") & (F.size("path") > 0))
    return (
        coded.select(*by, F.explode(aliases).alias("alias"), code_prefix(F.col("code")).alias("code"), "ordinal")
        .groupBy(*by, norm_text(F.col("alias")).alias("alias_key"))
        .agg(F.min_by("code", "ordinal").alias("code"))
    )


def resolve_see(nodes: DataFrame, aliases: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """IX-04: code-less nodes whose "see" target names a coded path; unmatched ones drop out."""
    refs = nodes.where(~_has("code") & _has("see")).select(
        *by,
        F.array_join("path", " ").alias("term"), "depth", "ordinal", norm_text(F.col("see")).alias("alias_key")
    )
    return refs.join(aliases, [*by, "alias_key"]).select(
        *by, "term", "code", "depth", F.lit(True).alias("via_see"), "ordinal"
    )


def is_holdout(term: Column, percent: int) -> Column:
    """IX-05: stable split on the SHA-1 of the normalised term; never held out at 0 percent."""
    if percent <= 0:
        return F.lit(False)
    head = F.substring(F.sha1(F.encode(norm_text(term), "utf-8")), 1, 8)
    return F.conv(head, 16, 10).cast("bigint") % 100 < percent


def holdout_split(terms: DataFrame, percent: int) -> DataFrame:
    return terms.withColumn("held_out", is_holdout(F.col("term"), percent))


def link_terms(terms: DataFrame, concepts: DataFrame, percent: int, by: Sequence[str] = ()) -> DataFrame:
    """IX-06: loaded terms, unique per (concept, term); direct before see, then the least depth."""
    kept = holdout_split(terms, percent).where("not held_out")
    linked = kept.join(concepts.select(*by, "code", "concept_id"), [*by, "code"])
    best = F.min(F.struct("via_see", "depth")).alias("b")
    return linked.groupBy(*by, "concept_id", "code", "term").agg(best).select(
        *by, "concept_id", "code", "term", "b.depth", "b.via_see"
    )


def link_report(terms: DataFrame, concepts: DataFrame, percent: int, by: Sequence[str] = ()) -> DataFrame:
    """Counts of the load, per release where `by` names its columns: parsed, held out, with a code it lacks, loaded."""
    known = concepts.select(*by, "code", F.lit(1).alias("known")).distinct()
    status = (
        F.when(F.col("held_out"), "held_out").when(F.col("known").isNull(), "unknown_code").otherwise("linked")
    )
    return (
        holdout_split(terms, percent).join(known, [*by, "code"], "left")
        .groupBy(*by, status.alias("status"), "via_see").agg(F.count(F.lit(1)).alias("terms"))
    )


def index_load(nodes: DataFrame, concepts: DataFrame, percent: int, by: Sequence[str] = ("version",)) -> DataFrame:
    """IX-02..IX-06 for all releases in the tables at once."""
    terms = direct_terms(nodes, by).unionByName(resolve_see(nodes, path_aliases(nodes, by=by), by))
    return link_terms(terms, concepts, percent, by)
