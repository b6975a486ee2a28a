"""Queries for evaluation, ablation, tuning and the further quality measures."""

from pyspark.sql import functions as F

from termweave.catalog import q_coding as QC
from termweave.catalog import q_search as QS
from termweave.catalog import views as V
from termweave.catalog.registry import query
from termweave.catalog.sqlviews import with_ctes
from termweave.operators import evaluate as EV
from termweave.operators import lexical as L
from termweave.operators import outlook as O
from termweave.operators import coding as C
from termweave.operators import ranking as R
from termweave.plans import ablation as A
from termweave.plans import search as S

SEED = "20260926"


def _entries(spark, sf):
    return V.index_entries(spark, sf).withColumn("ordinal", F.col("term_id"))


_ELIGIBLE = {
    "eligible": """SELECT term, code, depth, held_out, CASE depth WHEN 0 THEN '0' WHEN 1 THEN '1' ELSE '2+' END AS bucket, display AS gold_display
        FROM (SELECT term, min(code) AS code, min(depth) AS depth, any_value(held_out) AS held_out FROM index_entry WHERE length(term) >= 4 GROUP BY term HAVING count(DISTINCT code) = 1)
        JOIN (SELECT code AS c, display FROM concept) ON c = code
        WHERE EXISTS (SELECT 1 FROM prefix_all p WHERE p.version = '2027' AND p.is_billable AND p.prefix = code)""",
}


def _eligible_sql(extra=None):
    return with_ctes("index_entry", "concept", "prefix_all", extra={**_ELIGIBLE, **(extra or {})})


def eligible(spark, sf):
    return EV.eligible_terms(_entries(spark, sf), V.concepts(spark, sf)).join(
        V.index_entries(spark, sf).select("term", "held_out").distinct(), "term"
    )


@query("eligible_terms", _eligible_sql() + "SELECT term, code, bucket, gold_display FROM eligible")
def eligible_terms(spark, sf):
    return EV.eligible_terms(_entries(spark, sf), V.concepts(spark, sf)).select("term", "code", "bucket", "gold_display")


_STOP = "[" + ", ".join(f"'{w}'" for w in EV.OVERLAP_STOP_WORDS) + "]"


def _content(t):
    return f"list_filter(regexp_extract_all(lower({t}), '[a-z0-9]+'), lambda w: NOT list_contains({_STOP}, w))"


@query(
    "lexical_overlap",
    f"""WITH w AS (SELECT p_partkey, {_content("p_name || ' with ' || p_type || ' and ' || p_brand")} AS q, {_content("p_type || ' ' || p_name || ' ' || p_size")} AS t FROM part),
    o AS (SELECT p_partkey, CASE WHEN len(q) = 0 THEN 0 ELSE CAST(len(list_filter(q, lambda x: list_contains(t, x))) AS DOUBLE) / len(q) END AS overlap FROM w)
    SELECT p_partkey, round(overlap, 6) AS overlap, CASE WHEN overlap >= 0.67 THEN 'high' WHEN overlap >= 0.34 THEN 'partial' ELSE 'low' END AS overlap_bucket FROM o""",
)
def lexical_overlap(spark, sf):
    p = V.table(spark, sf, "part").select(
        "p_partkey",
        F.concat("p_name", F.lit(" with "), "p_type", F.lit(" and "), "p_brand").alias("query"),
        F.concat_ws(" ", "p_type", "p_name", F.col("p_size").cast("string")).alias("target"),
    )
    return EV.lexical_overlap(p).select("p_partkey", F.round("overlap", 6).alias("overlap"), "overlap_bucket")


_SAMPLE = {
    "sample": f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY md5('{SEED}|' || term), term) AS n FROM eligible WHERE held_out) WHERE n <= 200""",
}


def sample(spark, sf):
    return EV.stratified_sample(eligible(spark, sf).where("held_out"), ["bucket"], "term", EV.PER_DEPTH_BUCKET, SEED)


@query("stratified_sample", _eligible_sql(_SAMPLE) + "SELECT term, code, bucket FROM sample")
def stratified_sample(spark, sf):
    return sample(spark, sf).select("term", "code", "bucket")


def _term_queries(spark, sf):
    return V.index_entries(spark, sf).select(F.col("term_id").alias("query_id"), F.concat_ws(" ", F.col("term"), F.lit("with finish")).alias("query"))


@query("perturb_typo")
def perturb_typo(spark, sf):
    return EV.perturb_typo(_term_queries(spark, sf), SEED)


@query("perturb_shuffle")
def perturb_shuffle(spark, sf):
    return EV.perturb_shuffle(_term_queries(spark, sf), SEED)


@query(
    "dev_split",
    _eligible_sql({**_SAMPLE, "dev": f"SELECT *, row_number() OVER (ORDER BY md5('{SEED}-dev|' || term), term) AS n FROM eligible WHERE held_out AND term NOT IN (SELECT term FROM sample)"})
    + "SELECT term, code FROM dev WHERE n <= 300 UNION ALL SELECT term, 'test' FROM sample",
)
def dev_split(spark, sf):
    """The dev split and, told apart by the code column, the test sample it must not meet."""
    test = sample(spark, sf)
    dev = EV.dev_split(eligible(spark, sf).where("held_out"), test, "term", EV.DEV_SAMPLE, f"{SEED}-dev")
    return dev.select("term", "code").unionByName(test.select("term", F.lit("test").alias("code")))


@query(
    "flag_contamination",
    with_ctes("index_entry") + "SELECT term_id AS query_id, term, NOT held_out AS is_loaded_index_term FROM index_entry",
)
def flag_contamination(spark, sf):
    every = V.index_entries(spark, sf).select(F.col("term_id").alias("query_id"), F.upper("term").alias("query"), "term")
    return EV.flag_contamination(every, V.index_terms(spark, sf)).select("query_id", "term", "is_loaded_index_term")


_GOLD = {
    "gold": """SELECT l_orderkey AS query_id, unnest([min_by(category, (l_extendedprice, l_partkey)), max_by(code, (l_extendedprice, l_partkey))]) AS prefix
        FROM lineitem JOIN part_code ON p_partkey = l_partkey GROUP BY 1""",
}


@V.stored("order-gold")
def gold_queries(spark, sf):
    """Per order the category of its cheapest line and the code of its dearest one."""
    parts = V.part_codes(spark, sf).select(F.col("p_partkey").alias("l_partkey"), "category", "code")
    order = F.struct("l_extendedprice", "l_partkey")
    lines = V.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice").join(parts, "l_partkey")
    return lines.groupBy(F.col("l_orderkey").alias("query_id")).agg(
        F.array(F.min_by("category", order), F.max_by("code", order)).alias("gold")
    )


@query(
    "validate_gold",
    with_ctes("part_code", "prefix_all", extra={**_GOLD, "w": "SELECT query_id, replace(prefix, 'A', 'Q') AS prefix FROM gold"})
    + "SELECT query_id, prefix FROM w WHERE prefix NOT IN (SELECT prefix FROM prefix_all WHERE version = '2027' AND is_billable)",
)
def validate_gold(spark, sf):
    """Gold labels with the letter A mistyped."""
    wrong = gold_queries(spark, sf).withColumn("gold", F.transform("gold", lambda g: F.replace(g, F.lit("A"), F.lit("Q"))))
    return EV.validate_gold(wrong, V.concepts(spark, sf))


def order_hits(spark, sf):
    return QC.candidates(spark, sf).select(
        F.col("item_id").alias("query_id"), F.col("search_rank").alias("rank"), "code", F.array().cast("array<string>").alias("variants"), "matched_on"
    )


_HITS = {
    "hit": QC._F3["cand"],
    **_GOLD,
    "gr": """SELECT g.query_id, min(CASE WHEN starts_with(h.code, g.prefix) THEN search_rank END) AS rank,
        min(CASE WHEN starts_with(h.code, left(g.prefix, 3)) THEN search_rank END) AS family_rank
        FROM gold g LEFT JOIN hit h ON h.item_id = g.query_id GROUP BY 1""",
}


def _hits_sql():
    return with_ctes("part_code", extra=_HITS)


@V.stored("order-gold-rank")
def order_ranks(spark, sf):
    return EV.gold_rank(gold_queries(spark, sf), order_hits(spark, sf))


@query("gold_rank", _hits_sql() + "SELECT query_id, rank, family_rank FROM gr")
def gold_rank(spark, sf):
    return order_ranks(spark, sf).select("query_id", "rank", "family_rank")


@query("near_misses", _hits_sql() + "SELECT query_id, family_rank FROM gr WHERE rank IS NULL AND family_rank IS NOT NULL")
def near_misses(spark, sf):
    """Among gold labels narrowed to the full codes, so that families can be present without the code."""
    ranked = EV.near_misses(order_ranks(spark, sf))
    return ranked.select("query_id", "family_rank")


@query(
    "matched_on_share",
    _hits_sql() + "SELECT count(*) AS right_at_1, count(matched_on) AS from_index_term FROM gr JOIN hit ON item_id = query_id AND search_rank = 1 WHERE rank = 1",
)
def matched_on_share(spark, sf):
    return EV.matched_on_share(order_ranks(spark, sf), order_hits(spark, sf))


@query(
    "sibling_crowding",
    _hits_sql() + """SELECT item_id AS query_id, count(*) AS slots, count(*) - count(DISTINCT stem) AS duplicates,
    round((count(*) - count(DISTINCT stem)) / CAST(count(*) AS DOUBLE), 6) AS duplicate_share,
    round(count(*) FILTER (WHERE length(replace(code, '.', '')) = 7) / CAST(count(*) AS DOUBLE), 6) AS extended_share
    FROM (SELECT *, CASE WHEN length(replace(code, '.', '')) = 7 THEN left(code, length(code) - 1) ELSE code END AS stem FROM hit WHERE search_rank <= 100) GROUP BY 1""",
)
def sibling_crowding(spark, sf):
    out = EV.sibling_crowding(order_hits(spark, sf))
    return out.withColumn("duplicate_share", F.round("duplicate_share", 6)).withColumn("extended_share", F.round("extended_share", 6))


@query(
    "route_count",
    with_ctes("part_code", "index_term", extra={**_HITS,
        "rt": "SELECT code, count(*) AS routes FROM index_term GROUP BY 1",
        "pq": "SELECT g.query_id, any_value(gr.rank) AS rank, coalesce(sum(routes), 0) AS routes FROM gold g JOIN gr ON gr.query_id = g.query_id LEFT JOIN rt ON rt.code = g.prefix GROUP BY 1"})
    + "SELECT routes > 0 AS has_route, count(*) AS queries, round(count(*) FILTER (WHERE rank <= 100) / CAST(count(*) AS DOUBLE), 6) AS r_at_100 FROM pq GROUP BY 1",
)
def route_count(spark, sf):
    return EV.route_count(order_ranks(spark, sf), V.index_terms(spark, sf)).withColumn("r_at_100", F.round("r_at_100", 6))


@query(
    "empty_result_rate",
    with_ctes("part_code", extra={
        "h": "SELECT DISTINCT l_returnflag AS config, l_linestatus AS mode, l_orderkey FROM lineitem",
        "l": "SELECT c.config, m.mode FROM (VALUES ('A'), ('N'), ('R'), ('unused')) c(config) CROSS JOIN (VALUES ('F'), ('O')) m(mode)",
    })
    + """SELECT l.config, l.mode, count(h.l_orderkey) AS answered, (SELECT count(*) FROM orders) AS queries, (SELECT count(*) FROM orders) - count(h.l_orderkey) AS empty,
    round(((SELECT count(*) FROM orders) - count(h.l_orderkey)) / CAST((SELECT count(*) FROM orders) AS DOUBLE), 6) AS empty_rate
    FROM l LEFT JOIN h ON h.config = l.config AND h.mode = l.mode GROUP BY 1, 2""",
)
def empty_result_rate(spark, sf):
    queries = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("query_id"))
    hits = V.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_returnflag").alias("config"), F.col("l_linestatus").alias("mode"))
    lists = [{"config": c, "mode": m} for c in ("A", "N", "R", "unused") for m in ("F", "O")]
    return EV.empty_result_rate(queries, hits, lists).withColumn("empty_rate", F.round("empty_rate", 6))


# ── summaries over line items as results ──


def results(spark, sf):
    """Line items as evaluation results: the quantity is the rank, lines without tax are misses."""
    lines = V.table(spark, sf, "lineitem")
    rank = F.when(F.col("l_tax") > 0, F.col("l_quantity").cast("int"))
    return lines.select(
        F.col("l_returnflag").alias("config"),
        F.when(F.col("l_discount") < 0.05, "index_terms").otherwise("lay_terms").alias("dataset"),
        F.when(F.col("l_linestatus") == "O", "hybrid").otherwise("text").alias("mode"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("query_id"),
        rank.alias("rank"), F.when(F.col("l_tax") > 0.02, F.greatest(F.col("l_quantity").cast("int") - 5, F.lit(1))).alias("family_rank"),
        F.round(F.col("l_extendedprice") / 100, 0).alias("latency_ms"),
        F.when(F.col("l_discount") < 0.02, "high").otherwise("low").alias("overlap_bucket"),
        F.when(F.col("l_linenumber") < 3, "0").otherwise("1").alias("depth"),
        F.when(F.col("l_discount") >= 0.05, F.col("l_tax") > 0.04).alias("is_loaded_index_term"),
    )


_RESULT = """SELECT l_returnflag AS config, CASE WHEN l_discount < 0.05 THEN 'index_terms' ELSE 'lay_terms' END AS dataset,
  CASE WHEN l_linestatus = 'O' THEN 'hybrid' ELSE 'text' END AS mode, l_orderkey || '-' || l_linenumber || '-' || l_partkey AS query_id,
  CASE WHEN l_tax > 0 THEN CAST(l_quantity AS INT) END AS rank, CASE WHEN l_tax > 0.02 THEN greatest(CAST(l_quantity AS INT) - 5, 1) END AS family_rank,
  round(l_extendedprice / 100, 0) AS latency_ms, CASE WHEN l_discount < 0.02 THEN 'high' ELSE 'low' END AS overlap_bucket,
  CASE WHEN l_linenumber < 3 THEN '0' ELSE '1' END AS depth, CASE WHEN l_discount >= 0.05 THEN l_tax > 0.04 END AS is_loaded_index_term FROM lineitem"""


def _summary_sql(source: str, by: str) -> str:
    cuts = ", ".join(f"round(count(*) FILTER (WHERE rank <= {k}) / CAST(count(*) AS DOUBLE), 6) AS r_at_{k}" for k in EV.CUTOFFS)
    return f"""SELECT {by}, count(*) AS n, {cuts}, round(count(*) FILTER (WHERE family_rank <= 10) / CAST(count(*) AS DOUBLE), 6) AS family_at_10,
    round(sum(coalesce(1.0::DOUBLE / rank, 0)) / count(*), 6) AS mrr, median(latency_ms) AS p50_ms,
    max(CASE WHEN p = least(c, CAST(round_even(0.95::DOUBLE * (c - 1), 0) AS BIGINT) + 1) THEN latency_ms END) AS p95_ms
    FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY latency_ms) AS p, count(*) OVER (PARTITION BY {by}) AS c FROM {source}) GROUP BY {by}"""


def _neat(df):
    cols = [f"r_at_{k}" for k in EV.CUTOFFS] + ["family_at_10", "mrr"]
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query("summarise", f"WITH r AS ({_RESULT}) " + _summary_sql("r", "config, dataset, mode"))
def summarise(spark, sf):
    return _neat(EV.summarise(results(spark, sf), ["config", "dataset", "mode"]))


@query(
    "summary_slices",
    f"""WITH r AS ({_RESULT}), s AS (SELECT *, unnest(list_filter([dataset, CASE WHEN dataset = 'index_terms' THEN dataset || ' · overlap=' || overlap_bucket END,
    CASE WHEN dataset = 'index_terms' THEN dataset || ' · depth=' || depth END,
    CASE WHEN is_loaded_index_term THEN dataset || ' · verbatim index term' WHEN NOT is_loaded_index_term THEN dataset || ' · not an index term' END], lambda x: x IS NOT NULL)) AS slice FROM r) """
    + _summary_sql("s", "config, slice, mode"),
)
def summary_slices(spark, sf):
    return _neat(EV.summary_slices(results(spark, sf), "index_terms"))


@query(
    "compare_configs",
    f"""WITH r AS ({_RESULT}), m AS (SELECT config, dataset, round(count(*) FILTER (WHERE rank <= 10) / CAST(count(*) AS DOUBLE), 6) AS a,
    round(count(*) FILTER (WHERE rank <= 100) / CAST(count(*) AS DOUBLE), 6) AS b FROM r WHERE mode = 'hybrid' GROUP BY 1, 2)
    SELECT dataset, max(a) FILTER (WHERE config = 'A') AS "A_r_at_10", max(b) FILTER (WHERE config = 'A') AS "A_r_at_100",
    max(a) FILTER (WHERE config = 'N') AS "N_r_at_10", max(b) FILTER (WHERE config = 'N') AS "N_r_at_100",
    max(a) FILTER (WHERE config = 'R') AS "R_r_at_10", max(b) FILTER (WHERE config = 'R') AS "R_r_at_100" FROM m GROUP BY 1""",
)
def compare_configs(spark, sf):
    return EV.compare_configs(summarise(spark, sf), ["A", "N", "R"])


@query(
    "best_mode",
    f"""WITH r AS ({_RESULT}), m AS (SELECT config, dataset, mode, round(count(*) FILTER (WHERE rank <= 10) / CAST(count(*) AS DOUBLE), 6) AS r_at_10 FROM r GROUP BY 1, 2, 3)
    SELECT config, dataset, mode, r_at_10 = max(r_at_10) OVER (PARTITION BY config, dataset) AS is_best FROM m""",
)
def best_mode(spark, sf):
    return EV.best_mode(summarise(spark, sf)).select("config", "dataset", "mode", "is_best")


def _two_runs(spark, sf):
    """Line items of each order by part: one run ranked by quantity, the other by discount."""
    r = results(spark, sf).groupBy("dataset", "query_id", "mode")
    before = r.agg(F.min("rank").alias("rank"))
    after = r.agg(F.min("family_rank").alias("rank"))
    return before, after


@query(
    "rank_movement",
    f"""WITH r AS ({_RESULT}), q AS (SELECT dataset, query_id, mode, min(rank) AS a, min(family_rank) AS b FROM r GROUP BY 1, 2, 3),
    k AS (SELECT *, unnest([1, 10, 100]) AS k FROM q)
    SELECT dataset, mode, k, count(*) FILTER (WHERE NOT coalesce(a <= k, FALSE) AND coalesce(b <= k, FALSE)) AS entered,
    count(*) FILTER (WHERE coalesce(a <= k, FALSE) AND NOT coalesce(b <= k, FALSE)) AS left FROM k GROUP BY 1, 2, 3""".replace("AS left", 'AS "left"'),
)
def rank_movement(spark, sf):
    return EV.rank_movement(*_two_runs(spark, sf))


# ── ablation and tuning over real searches ──


@V.stored("ablation-hits")
def ablation_hits(spark, sf):
    return A.run_ablation(V.embedded_queries(spark, sf), V.release(spark, sf))


@query("run_ablation")
def run_ablation(spark, sf):
    """Recall and reciprocal rank of every configuration and mode over all held-out terms."""
    lists = [{"config": c, "mode": m} for c in A.CONFIGS for m in ("text", "semantic", "hybrid")]
    ranked = EV.gold_rank(V.eval_queries(spark, sf), ablation_hits(spark, sf), lists)
    return ranked.groupBy("config", "mode").agg(*EV.metrics(F.col("rank"), F.col("family_rank")))


@query("tune_weight")
def tune_weight(spark, sf):
    queries, release = V.embedded_queries(spark, sf), V.release(spark, sf)
    text = V.materialise(S.rank_method(queries, release, "text"), "tune-text")
    semantic = V.materialise(S.rank_method(queries, release, "semantic"), "tune-semantic")
    return A.tune_weight(V.eval_queries(spark, sf), text, semantic)


_TUNE = with_ctes("candidate_row", "concept", "prefix_all", extra={
    **QS._rank("collapsed"), **_GOLD,
    "wt": f"SELECT unnest({[float(w) for w in A.WEIGHTS]}::DOUBLE[]) AS weight",
    "f0": """SELECT w.weight, coalesce(t.query_id, s.query_id) AS query_id, coalesce(t.code, s.code) AS code, coalesce(t.sort_order, s.sort_order) AS sort_order,
        coalesce(t.stem, s.stem) AS stem, list_concat(coalesce(t.variants, []), list_concat(coalesce([s.code], []), coalesce(s.variants, []))) AS others,
        coalesce(w.weight / (60 + t.rank), 0) + coalesce(1.0::DOUBLE / (60 + s.rank), 0) AS score
        FROM (SELECT * FROM collapsed WHERE method = 'text') t FULL JOIN (SELECT * FROM collapsed WHERE method = 'semantic') s ON t.query_id = s.query_id AND t.stem = s.stem CROSS JOIN wt w""",
    "f1": "SELECT *, row_number() OVER (PARTITION BY weight, query_id ORDER BY round(score, 12) DESC, sort_order, code) AS rank FROM f0",
    "f2": "SELECT weight, query_id, rank, unnest(list_concat([code], others)) AS c FROM f1 WHERE rank <= 100",
    "f3": "SELECT f2.weight, f2.query_id, min(f2.rank) AS rank FROM f2 JOIN gold g ON g.query_id = f2.query_id AND starts_with(f2.c, g.prefix) GROUP BY 1, 2",
    "nq": "SELECT count(DISTINCT query_id) AS n FROM gold",
})


@query(
    "tune_weight_fixed_rankings",
    _TUNE + """SELECT 'hybrid ' || CAST(weight AS VARCHAR) AS list, any_value(n) AS n, round(count(*) FILTER (WHERE rank <= 1) / CAST(any_value(n) AS DOUBLE), 6) AS r_at_1,
    round(count(*) / CAST(any_value(n) AS DOUBLE), 6) AS r_at_100, round(sum(1.0::DOUBLE / rank) / any_value(n), 6) AS mrr FROM f3 CROSS JOIN nq GROUP BY weight""",
)
def tune_weight_fixed_rankings(spark, sf):
    """Weight tuning over the line items' rankings."""
    text = V.materialise(R.collapse_variants(QS._ranked_lists(spark, sf, "text")), "fixed-text")
    semantic = V.materialise(R.collapse_variants(QS._ranked_lists(spark, sf, "semantic")), "fixed-semantic")
    out = A.tune_weight(gold_queries(spark, sf), text, semantic).where("weight is not null")
    return out.select("list", "n", F.round("r_at_1", 6).alias("r_at_1"), F.round("r_at_100", 6).alias("r_at_100"), F.round("mrr", 6).alias("mrr"))


# ── further measures ──


def scored_items(spark, sf):
    """Assigned items and whether the dearest line's code was assigned."""
    a = C.assign(QC.ranked_scores(spark, sf)).select(F.col("item_id"), "assigned_code", "probability")
    gold = order_gold(spark, sf)
    return a.join(gold, "item_id").withColumn("correct", (F.col("assigned_code") == F.col("code")).cast("int"))


def order_gold(spark, sf):
    return gold_queries(spark, sf).select(F.col("query_id").alias("item_id"), F.element_at("gold", 2).alias("code"))


_SCORED = {
    **QC._F3,
    **_GOLD,
    "og": "SELECT query_id AS item_id, max(prefix) FILTER (WHERE length(prefix) > 3) AS code FROM gold GROUP BY 1",
    "si": "SELECT a.item_id, assigned_code, probability, og.code, CASE WHEN assigned_code = og.code THEN 1 ELSE 0 END AS correct FROM assigned a JOIN og ON og.item_id = a.item_id",
}


def _scored_sql():
    return with_ctes("part_code", extra=_SCORED)


@query(
    "calibration_bins",
    _scored_sql() + "SELECT least(CAST(floor(probability * 10) AS INT), 9) AS bin, count(*) AS n, round(avg(probability), 6) AS mean_probability, round(avg(correct), 6) AS observed FROM si GROUP BY 1",
)
def calibration_bins(spark, sf):
    out = O.calibration_bins(scored_items(spark, sf))
    return out.withColumn("mean_probability", F.round("mean_probability", 6)).withColumn("observed", F.round("observed", 6))


@query(
    "calibration_error",
    _scored_sql() + """, b AS (SELECT least(CAST(floor(probability * 10) AS INT), 9) AS bin, count(*) AS n, avg(probability) AS p, avg(correct) AS o FROM si GROUP BY 1)
    SELECT round((SELECT sum(n * abs(p - o)) / sum(n) FROM b), 6) AS ece, round(avg((probability - correct) ** 2), 6) AS brier FROM si""",
)
def calibration_error(spark, sf):
    out = O.calibration_error(scored_items(spark, sf))
    return out.select(F.round("ece", 6).alias("ece"), F.round("brier", 6).alias("brier"))


@query(
    "threshold_curve",
    _scored_sql() + """, t AS (SELECT *, unnest([0.25, 0.5, 0.75, 0.9]::DOUBLE[]) AS threshold FROM si)
    SELECT threshold, round(count(*) FILTER (WHERE probability < threshold) / CAST(count(*) AS DOUBLE), 6) AS close_share,
    round(count(*) FILTER (WHERE probability >= threshold AND correct = 0) / nullif(CAST(count(*) FILTER (WHERE probability >= threshold) AS DOUBLE), 0), 6) AS standard_error FROM t GROUP BY 1""",
)
def threshold_curve(spark, sf):
    out = O.threshold_curve(scored_items(spark, sf), [0.25, 0.5, 0.75, 0.9])
    return out.select("threshold", F.round("close_share", 6).alias("close_share"), F.round("standard_error", 6).alias("standard_error"))


@query(
    "topk_given_retrieved",
    _scored_sql() + """SELECT count(*) AS retrieved, round(avg(CASE WHEN rank <= 1 THEN 1 ELSE 0 END), 6) AS top_1, round(avg(CASE WHEN rank <= 3 THEN 1 ELSE 0 END), 6) AS top_3,
    round(avg(CASE WHEN rank <= 5 THEN 1 ELSE 0 END), 6) AS top_5 FROM ranked r JOIN og ON og.item_id = r.item_id AND og.code = r.code""",
)
def topk_given_retrieved(spark, sf):
    out = O.topk_given_retrieved(QC.ranked_scores(spark, sf).where("code is not null"), order_gold(spark, sf))
    return out.select("retrieved", *[F.round(f"top_{k}", 6).alias(f"top_{k}") for k in (1, 3, 5)])


@query(
    "nota_quality",
    _scored_sql() + """, s AS (SELECT r.item_id, bool_or(r.code IS NULL AND rank = 1) AS said, bool_or(coalesce(r.code = og.code, FALSE)) AS present FROM ranked r JOIN og ON og.item_id = r.item_id GROUP BY 1)
    SELECT round(count(*) FILTER (WHERE said AND NOT present) / CAST(count(*) FILTER (WHERE said) AS DOUBLE), 6) AS precision,
    round(count(*) FILTER (WHERE said AND NOT present) / CAST(count(*) FILTER (WHERE NOT present) AS DOUBLE), 6) AS recall FROM s""",
)
def nota_quality(spark, sf):
    out = O.nota_quality(QC.ranked_scores(spark, sf), order_gold(spark, sf))
    return out.select(F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


def _code_sets(spark, sf):
    owner = QC.orders(spark, sf).select("item_id", "encounter_id")
    predicted = scored_items(spark, sf).select("item_id", F.col("assigned_code").alias("code")).join(owner, "item_id")
    gold = order_gold(spark, sf).join(owner, "item_id")
    return predicted, gold


@query(
    "encounter_f1",
    _scored_sql() + """, p AS (SELECT DISTINCT encounter_id, s.assigned_code AS code FROM si s JOIN item i ON i.item_id = s.item_id),
    g AS (SELECT DISTINCT encounter_id, og.code FROM og JOIN item i ON i.item_id = og.item_id),
    e AS (SELECT coalesce(p.encounter_id, g.encounter_id) AS encounter_id, count(CASE WHEN p.code IS NOT NULL AND g.code IS NOT NULL THEN 1 END) AS tp, count(p.code) AS np, count(g.code) AS ng
      FROM p FULL JOIN g ON p.encounter_id = g.encounter_id AND p.code = g.code GROUP BY 1)
    SELECT round(2.0::DOUBLE * sum(tp) / (sum(np) + sum(ng)), 6) AS micro_f1, round(avg(2.0::DOUBLE * tp / (np + ng)), 6) AS macro_f1, round(avg(CASE WHEN tp = np AND tp = ng THEN 1 ELSE 0 END), 6) AS exact FROM e""",
)
def encounter_f1(spark, sf):
    out = O.encounter_f1(*_code_sets(spark, sf))
    return out.select(*[F.round(c, 6).alias(c) for c in ("micro_f1", "macro_f1", "exact")])


@query(
    "accuracy_by_level",
    _scored_sql() + """, l AS (SELECT replace(assigned_code, '.', '') AS a, replace(code, '.', '') AS g, unnest([1, 3, 4, 5, 6, 7]) AS level FROM si)
    SELECT level, count(*) AS n, round(avg(CASE WHEN left(a, level) = left(g, level) THEN 1 ELSE 0 END), 6) AS accuracy FROM l WHERE length(g) >= level GROUP BY 1""",
)
def accuracy_by_level(spark, sf):
    pairs = scored_items(spark, sf).select(F.col("assigned_code").alias("assigned"), F.col("code").alias("gold"))
    return O.accuracy_by_level(pairs).withColumn("accuracy", F.round("accuracy", 6))


@query(
    "assemble_codes",
    with_ctes("part_code", extra={
        "m": "SELECT 'enc-' || o_custkey AS encounter_id, category AS code, min(l_orderkey) AS first, count(*) AS mentions FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part_code ON p_partkey = l_partkey WHERE l_returnflag <> 'R' GROUP BY 1, 2"})
    + "SELECT *, row_number() OVER (PARTITION BY encounter_id ORDER BY first, code) AS position FROM m",
)
def assemble_codes(spark, sf):
    """Line items as findings, returned ones negated, coded by category."""
    parts = V.part_codes(spark, sf).select(F.col("p_partkey").alias("l_partkey"), F.col("category").alias("code"))
    lines = V.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("item_id"), "l_partkey", (F.col("l_returnflag") == "R").alias("negated"))
    findings = lines.join(parts, "l_partkey").join(QC.orders(spark, sf).select("item_id", "encounter_id", "sequence"), "item_id")
    return O.assemble_codes(findings)


@query(
    "temperature_scale",
    _scored_sql() + """, t AS (SELECT *, unnest([0.5, 1.0, 2.0]::DOUBLE[]) AS t FROM ranked WHERE code IS NOT NULL AND probability > 0),
    i AS (SELECT t.item_id, t.t, sum(CASE WHEN t.code = og.code THEN pow(probability, 1 / t.t) END) / sum(pow(probability, 1 / t.t)) AS p FROM t LEFT JOIN og ON og.item_id = t.item_id GROUP BY 1, 2),
    l AS (SELECT t, avg(-ln(p)) AS log_loss, count(*) AS n FROM i WHERE p IS NOT NULL GROUP BY 1)
    SELECT t AS temperature, round(log_loss, 6) AS log_loss, n, t = (SELECT min_by(t, log_loss) FROM l) AS is_best FROM l""",
)
def temperature_scale(spark, sf):
    scores = QC.ranked_scores(spark, sf).where("code is not null and probability > 0").select("item_id", "code", "probability")
    out = O.temperature_scale(scores, order_gold(spark, sf), [0.5, 1.0, 2.0])
    return out.withColumn("log_loss", F.round("log_loss", 6))


_BM25 = {
    **{k: QS._MATCH[k] for k in ("q", "qt")},
    "fold": "SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY text",
    "tok": "SELECT doc_id, unnest(list_filter(" + QS._WORDS.format(t="text") + f", lambda w: w <> '' AND NOT list_contains({QS._STOP}, w))) AS token FROM fold",
    "tf": "SELECT doc_id, token, count(*) AS tf FROM tok GROUP BY 1, 2",
    "sz": "SELECT f.doc_id, count(token) AS size FROM fold f LEFT JOIN tok ON tok.doc_id = f.doc_id GROUP BY 1",
    "df": "SELECT token, count(*) AS df FROM tf GROUP BY 1",
}


@query(
    "bm25_rank",
    with_ctes(extra=_BM25) + """SELECT item_id, tf.doc_id, round(sum(ln(1 + ((SELECT count(*) FROM sz) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / (SELECT avg(size) FROM sz)))), 5) AS score
    FROM qt JOIN tf ON tf.token = qt.token JOIN df ON df.token = tf.token JOIN sz ON sz.doc_id = tf.doc_id GROUP BY 1, 2"""
    .replace("SELECT item_id, tf.doc_id, round", "SELECT item_id, d.doc_id, score FROM (SELECT item_id, tf.doc_id, round") + ") s JOIN fold f ON f.doc_id = s.doc_id JOIN documents d ON d.text = f.text",
)
def bm25_rank(spark, sf):
    """Benchmark passages against all documents; copies share their text's score."""
    queries, index = QS.benchmark_queries(spark, sf), QS.document_index(spark, sf)
    scored = O.bm25_rank(L.analyze_queries(queries, stem=False), index)
    copies = index.rows.select("source", "doc_id", "row_id")
    ids = queries.select(F.col("query_id").cast("bigint").alias("item_id"), F.md5(F.regexp_replace("query", r"^\s+|\s+$", "")).alias("text_id"))
    return scored.join(copies, ["source", "doc_id"]).join(ids, "text_id").select("item_id", F.col("row_id").alias("doc_id"), F.round("score", 5).alias("score"))
