"""Evaluation of retrieval (E-01..E-12, E-15..E-20): datasets, ranks, metrics, comparisons."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from termweave.functions.codes import code_prefixes, norm_text, undotted, dotted, variant_stem
from termweave.operators.hierarchy import has_billable

# Words the overlap ignores, words a shuffle drops, cut-offs and sample sizes.
OVERLAP_STOP_WORDS = (
    "a an and as at by for from in of on or the to with without due nos nec other unspecified".split()
)
CONNECTIVES = "with without and of in due to".split()
CUTOFFS = (1, 5, 10, 50, 100)
PER_DEPTH_BUCKET = 200
SEEN_SAMPLE = 200
PERTURB_SAMPLE = 150
DEV_SAMPLE = 300
LIMIT = 100
FAMILY_CUTOFF = 10


def eligible_terms(terms: DataFrame, concepts: DataFrame) -> DataFrame:
    """E-01: direct terms of at least four characters with one code that can be completed and named.

    terms: term, code, depth, via_see, ordinal.
    """
    direct = terms.where(~F.col("via_see") & (F.length("term") >= 4))
    single = (
        direct.groupBy("term")
        .agg(F.min("code").alias("code"), F.max("code").alias("other"), F.min_by("depth", "ordinal").alias("depth"))
        .where("code = other").drop("other")
    )
    completed = has_billable(single.withColumn("prefix", F.col("code")), concepts)
    named = completed.join(concepts.select("code", F.col("display").alias("gold_display")), "code")
    bucket = F.when(F.col("depth") == 0, "0").when(F.col("depth") == 1, "1").otherwise("2+")
    return named.select("term", "code", "depth", bucket.alias("bucket"), "gold_display")


def content_words(c: Column) -> Column:
    found = F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1))
    return F.filter(found, lambda w: ~w.isin(OVERLAP_STOP_WORDS))


def lexical_overlap(df: DataFrame, query: str = "query", target: str = "target") -> DataFrame:
    """E-02: share of the query's content words, with multiplicity, that the target contains."""
    both = df.withColumn("_q", content_words(F.col(query))).withColumn("_t", content_words(F.col(target)))
    hits = F.size(F.filter("_q", lambda w: F.array_contains(F.col("_t"), w)))
    share = F.when(F.size("_q") > 0, hits / F.size("_q")).otherwise(F.lit(0.0))
    bucket = F.when(F.col("overlap") >= 0.67, "high").when(F.col("overlap") >= 0.34, "partial").otherwise("low")
    return both.withColumn("overlap", share).withColumn("overlap_bucket", bucket).drop("_q", "_t")


def draw(seed: int | str, *cols: Column | str) -> Column:
    """Hash order that stands for a seeded draw; the same in every engine that has MD5."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *cols))


def stratified_sample(rows: DataFrame, strata: list[str], key: str, size: int, seed: int | str) -> DataFrame:
    """E-03: up to `size` rows per stratum in hash order of `key` (which is unique)."""
    order = draw(seed, key)
    if not strata:
        return rows.orderBy(order, key).limit(size)
    return (
        rows.withColumn("_n", F.row_number().over(W.partitionBy(*strata).orderBy(order, key)))
        .where(F.col("_n") <= size).drop("_n")
    )


def _pick(seed: str, key: Column, n: Column) -> Column:
    """A hash-driven integer in 0..n-1."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), key)), 1, 8), 16, 10).cast("bigint"), n).cast("int")


def perturb_typo(queries: DataFrame, seed: int | str, key: str = "query_id") -> DataFrame:
    """E-04: one edit inside one alphabetic word of at least five characters; other queries drop out."""
    words = F.filter(F.split("query", r"\s+"), lambda w: F.length(w) > 0)
    fit = F.filter(F.sequence(F.lit(0), F.size("_w") - 1), lambda i: F.get(F.col("_w"), i).rlike(r"^\p{L}{5,}$"))
    k = F.col(key).cast("string")
    usable = (
        queries.withColumn("_w", words).where(F.size("_w") > 0).withColumn("_fit", fit).where(F.size("_fit") > 0)
        .withColumn("_i", F.get("_fit", _pick(f"{seed}-word", k, F.size("_fit"))))
        .withColumn("_x", F.get("_w", F.col("_i")))
        .withColumn("_j", _pick(f"{seed}-at", k, F.length("_x") - 2) + 1)
        .withColumn("_op", _pick(f"{seed}-op", k, F.lit(3)))
    )
    x, j = F.col("_x"), F.col("_j")
    rest = F.substring(x, j + 2, F.length(x))
    letter = F.char(_pick(f"{seed}-letter", k, F.lit(26)) + 97)
    edited = (
        F.when(F.col("_op") == 0, F.concat(F.substring(x, F.lit(1), j), rest))
        .when(F.col("_op") == 1, F.concat(F.substring(x, F.lit(1), j - 1), F.substring(x, j + 1, F.lit(1)), F.substring(x, j, F.lit(1)), rest))
        .otherwise(F.concat(F.substring(x, F.lit(1), j), letter, rest))
    )
    spread = usable.withColumn("_e", edited).withColumn(
        "_out", F.array_join(F.transform("_w", lambda w, i: F.when(i == F.col("_i"), F.col("_e")).otherwise(w)), " ")
    )
    kept = [c for c in queries.columns if c != "query"]
    return spread.select(*kept, F.col("query").alias("original"), F.col("_out").alias("query"))


def perturb_shuffle(queries: DataFrame, seed: int | str, key: str = "query_id", tries: int = 10) -> DataFrame:
    """E-05: words without connectives in a hash order that differs from the original one."""
    words = F.filter(
        F.split("query", r"\s+"), lambda w: (F.length(w) > 0) & ~F.lower(w).isin(CONNECTIVES)
    )
    base = queries.withColumn("_w", words).where(F.size("_w") >= 3).withColumn("_k", F.col(key).cast("string"))

    def order(attempt: int) -> Column:
        marked = F.transform(
            "_w",
            lambda w, i: F.struct(F.md5(F.concat_ws("|", F.lit(f"{seed}-{attempt}"), F.col("_k"), i.cast("string"))).alias("h"), w.alias("w")),
        )
        return F.transform(F.array_sort(marked), lambda x: x["w"])

    out = F.coalesce(*[F.when(order(t) != F.col("_w"), order(t)) for t in range(tries)])
    kept = [c for c in queries.columns if c != "query"]
    return base.withColumn("_out", out).where("_out is not null").select(
        *kept, F.col("query").alias("original"), F.array_join("_out", " ").alias("query")
    )


def dev_split(pool: DataFrame, test: DataFrame, key: str, size: int, seed: int | str) -> DataFrame:
    """E-06: held-out rows that are not in the test sample."""
    return stratified_sample(pool.join(test.select(key), key, "left_anti"), [], key, size, seed)


def flag_contamination(queries: DataFrame, loaded: DataFrame) -> DataFrame:
    """E-07: whether a query's normalised text is a loaded term."""
    terms = loaded.select(norm_text(F.col("term")).alias("_n"), F.lit(True).alias("_hit")).distinct()
    return (
        queries.withColumn("_n", norm_text(F.col("query"))).join(terms, "_n", "left")
        .withColumn("is_loaded_index_term", F.coalesce("_hit", F.lit(False))).drop("_n", "_hit")
    )


def validate_gold(queries: DataFrame, concepts: DataFrame) -> DataFrame:
    """E-08: (query_id, gold) prefixes that no billable code starts with."""
    prefixes = queries.select("query_id", F.explode("gold").alias("prefix"))
    good = has_billable(prefixes.select("prefix").distinct(), concepts)
    return prefixes.join(good, "prefix", "left_anti")


GOLD_FLAGS = ("_exact", "_family")


def flag_gold(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Adds to hits whether their code or a variant starts with a gold prefix of the query (`_exact`), or with its family.

    A query's prefixes are compared with those of the codes in the row, so no hit is repeated per code and prefix.
    """
    gold = queries.select("query_id", F.explode("gold").alias("g"))
    wanted = gold.groupBy("query_id").agg(
        F.collect_set(dotted(undotted(F.col("g")))).alias("_gold"), F.collect_set(F.substring(F.col("g"), 1, 3)).alias("_families")
    )
    prefixes = F.transform(F.concat(F.array("code"), "variants"), lambda c: code_prefixes(c))
    reached = F.flatten(F.filter(prefixes, lambda p: p.isNotNull()))
    meets = lambda c: F.coalesce(F.arrays_overlap("_reached", c), F.lit(False))
    flags = dict(zip(GOLD_FLAGS, (meets("_gold"), meets("_families"))))
    return hits.join(wanted, "query_id", "left").withColumn("_reached", reached).withColumns(flags).drop("_gold", "_families", "_reached")


def gold_rank(
    queries: DataFrame, hits: DataFrame, lists: Sequence[Mapping[str, str]] = (), limit: int = LIMIT
) -> DataFrame:
    """E-09: rank of the first hit whose code or variant starts with a gold prefix, and family rank.

    Hits that `flag_gold` has marked are not compared again. `lists`
    names the result lists in `hits` when it holds several, e.g. {"config": "r4a", "mode": "text"};
    every query then has a row per list, also where the list is empty.
    """
    by = list(lists[0]) if lists else []
    keys = [*by, "query_id"]
    top = hits.where(F.col("rank") <= limit)
    flagged = top if set(GOLD_FLAGS) <= set(hits.columns) else flag_gold(queries, top)
    found = flagged.where(F.col("_exact") | F.col("_family")).groupBy(*keys).agg(
        F.min(F.when(F.col("_exact"), F.col("rank"))).alias("rank"), F.min(F.when(F.col("_family"), F.col("rank"))).alias("family_rank"),
    )
    if not by:
        return queries.join(found, "query_id", "left")
    names = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in one.items()]) for one in lists])
    tagged = queries.withColumn("_l", F.explode(names)).select("_l.*", *queries.columns)
    return tagged.join(found, keys, "left")


def metrics(rank: Column, family_rank: Column) -> list[Column]:
    n = F.count(F.lit(1))
    return [
        n.alias("n"),
        *[(F.count_if(rank <= k) / n).alias(f"r_at_{k}") for k in CUTOFFS],
        (F.count_if(family_rank <= FAMILY_CUTOFF) / n).alias("family_at_10"),
        (F.sum(F.coalesce(1 / rank, F.lit(0.0))) / n).alias("mrr"),
    ]


def summarise(results: DataFrame, by: list[str]) -> DataFrame:
    """E-10: recall, family recall, reciprocal rank, and median and 95th-percentile latency.

    The percentiles come from counts per whole millisecond, which tell in which of these a percentile lies; only the
    latencies of those are put in order. A large group is never sorted by one task.
    """
    counted = results.groupBy(*by, "latency_ms").agg(F.count(F.lit(1)).alias("_c")).withColumn("_range", F.floor("latency_ms"))
    ranges = counted.groupBy(*by, "_range").agg(F.sum("_c").alias("_k"))
    earlier = W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.withColumn("_before", F.coalesce(F.sum("_k").over(earlier), F.lit(0))).withColumn("_n", F.sum("_k").over(W.partitionBy(*by)))

    def value_at(k: Column) -> Column:
        return F.min(F.when(F.col("_cum") >= k, F.col("latency_ms")))

    low, high = F.floor((F.col("_n") + 1) / 2), F.floor((F.col("_n") + 2) / 2)
    edge = F.least(F.col("_n"), F.bround(0.95 * (F.col("_n") - 1)).cast("bigint") + 1)
    holds = F.lit(False)
    for k in (low, high, edge):
        holds = holds | ((F.col("_before") < k) & (k <= F.col("_before") + F.col("_k")))
    asked = ranges.where(holds).select(*by, "_range", "_before", "_n")
    inside = F.sum("_c").over(W.partitionBy(*by, "_range").orderBy("latency_ms"))
    latency = (
        counted.join(asked, [*by, "_range"]).withColumn("_cum", F.col("_before") + inside).groupBy(*by)
        .agg(((value_at(low) + value_at(high)) / 2).alias("p50_ms"), value_at(edge).alias("p95_ms"))
    )
    quality = results.groupBy(*by).agg(*metrics(F.col("rank"), F.col("family_rank")))
    return quality.join(latency, by)


def summary_slices(results: DataFrame, main_set: str) -> DataFrame:
    """E-11: the summary per dataset and per slice; a row counts in each slice it belongs to.

    results: config, dataset, mode, rank, family_rank, latency_ms, overlap_bucket, depth,
    is_loaded_index_term (the last three NULL where a set has no such label).
    """
    main = F.col("dataset") == main_set

    def label(*parts: str | Column) -> Column:
        return F.concat(F.col("dataset"), F.lit(" · "), *[F.lit(p) if isinstance(p, str) else p for p in parts])

    side = F.when(F.col("is_loaded_index_term"), label("verbatim index term")).when(
        ~F.col("is_loaded_index_term"), label("not an index term")
    )
    labels = F.array_compact(
        F.array(
            F.col("dataset"),
            F.when(main, label("overlap=", F.col("overlap_bucket"))),
            F.when(main, label("depth=", F.col("depth"))),
            side,
        )
    )
    sliced = results.withColumn("slice", F.explode(labels))
    return summarise(sliced, ["config", "slice", "mode"])


def compare_configs(summary: DataFrame, configs: list[str]) -> DataFrame:
    """E-12: hybrid recall at 10 and 100 of every configuration side by side."""
    return (
        summary.where("mode = 'hybrid'").groupBy("dataset").pivot("config", configs)
        .agg(F.first("r_at_10").alias("r_at_10"), F.first("r_at_100").alias("r_at_100"))
    )


def best_mode(summary: DataFrame) -> DataFrame:
    """E-12: marks the modes with the best recall at 10 per configuration and dataset."""
    best = F.max("r_at_10").over(W.partitionBy("config", "dataset"))
    return summary.withColumn("is_best", F.col("r_at_10") == best)


def sibling_crowding(hits: DataFrame, limit: int = LIMIT) -> DataFrame:
    """E-15: per query the share of slots held by siblings of a better-ranked code."""
    top = hits.where(F.col("rank") <= limit).withColumn("stem", variant_stem(F.col("code")))
    extended = F.length(F.replace(F.col("code"), F.lit("."), F.lit(""))) == 7
    families = top.groupBy("query_id", "stem").agg(F.count(F.lit(1)).alias("n"), F.count_if(extended).alias("x"))
    slots = F.sum("n")
    return families.groupBy("query_id").agg(
        slots.alias("slots"), (slots - F.count(F.lit(1))).alias("duplicates"),
        ((slots - F.count(F.lit(1))) / slots).alias("duplicate_share"), (F.sum("x") / slots).alias("extended_share"),
    )


def near_misses(ranked: DataFrame) -> DataFrame:
    """E-16: missed queries whose gold family is present."""
    return ranked.where("rank is null and family_rank is not null")


def matched_on_share(ranked: DataFrame, hits: DataFrame) -> DataFrame:
    """E-17: of the queries right at rank 1, those whose top hit came from an index term."""
    top = hits.where("rank = 1").select("query_id", "matched_on")
    right = ranked.where("rank = 1").select("query_id").join(top, "query_id")
    return right.agg(F.count(F.lit(1)).alias("right_at_1"), F.count("matched_on").alias("from_index_term"))


def rank_movement(before: DataFrame, after: DataFrame, cutoffs: tuple[int, ...] = (1, 10, 100)) -> DataFrame:
    """E-18: queries that enter or leave the top k between two configurations."""
    on = ["dataset", "query_id", "mode"]
    both = before.select(*on, F.col("rank").alias("a")).join(after.select(*on, F.col("rank").alias("b")), on)
    tested = both.withColumn("k", F.explode(F.array(*[F.lit(k) for k in cutoffs])))
    was = F.coalesce(F.col("a") <= F.col("k"), F.lit(False))
    now = F.coalesce(F.col("b") <= F.col("k"), F.lit(False))
    return tested.groupBy("dataset", "mode", "k").agg(
        F.count_if(~was & now).alias("entered"), F.count_if(was & ~now).alias("left")
    )


def route_count(ranked: DataFrame, loaded: DataFrame) -> DataFrame:
    """E-19: recall at 100 by whether the gold code has a loaded index term."""
    routes = loaded.groupBy("code").agg(F.count(F.lit(1)).alias("routes"))
    per_query = (
        ranked.select("query_id", "rank", F.explode("gold").alias("code")).join(routes, "code", "left")
        .groupBy("query_id").agg(F.first("rank").alias("rank"), F.sum(F.coalesce("routes", F.lit(0))).alias("routes"))
    )
    return per_query.groupBy((F.col("routes") > 0).alias("has_route")).agg(
        F.count(F.lit(1)).alias("queries"), (F.count_if(F.col("rank") <= LIMIT) / F.count(F.lit(1))).alias("r_at_100")
    )


def empty_result_rate(queries: DataFrame, hits: DataFrame, lists: Sequence[Mapping[str, str]]) -> DataFrame:
    """E-20: per result list the number of queries without a single hit; `lists` as in `gold_rank`.

    A list that answered nothing has a row too. Only names and counts are joined, so nothing grows with queries times lists.
    """
    by = list(lists[0])
    names = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in one.items()]) for one in lists])
    total = queries.agg(F.countDistinct("query_id").alias("queries")).select("queries", F.explode(names).alias("_l")).select("_l.*", "queries")
    answered = hits.groupBy(*by).agg(F.countDistinct("query_id").alias("answered"))
    return (
        total.join(answered, by, "left").withColumn("answered", F.coalesce("answered", F.lit(0)))
        .withColumn("empty", F.col("queries") - F.col("answered"))
        .withColumn("empty_rate", F.col("empty") / F.col("queries"))
    )
