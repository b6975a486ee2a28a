"""Queries for the coding pipeline, review, billing and audit.

Conversation turns are encounters (their sentences the items) for intake. Customers are
encounters, their orders items and the orders' line items candidates for scoring and review.
"""

import math

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from termweave.catalog import views as V
from termweave.catalog.registry import query
from termweave.catalog.sqlviews import with_ctes
from termweave.operators import coding as C
from termweave.operators import review as RV
from termweave.plans import intake as P
from termweave.session import spread

# ── intake ──


def encounter_lines(spark, sf):
    """One JSON document per conversation turn: the text is the note, its sentences are the items."""
    t = V.table(spark, sf, "conversations")
    sentences = F.filter(F.transform(F.split("text", r"[.\n]+"), lambda s: F.trim(s)), lambda s: F.length(s) > 0)
    items = F.transform(sentences, lambda s: F.struct(s.alias("text")))

    def when_role(role):
        return F.when(F.col("role") == role, items)

    doc = F.struct(
        F.concat_ws("-", F.lit("enc"), "conv_id", "turn").alias("encounter_id"),
        F.concat(F.lit("pat-"), F.col("conv_id").cast("string")).alias("patient_id"),
        F.col("role").alias("department"), F.col("text").alias("soap_note"),
        when_role("user").alias("conditions"), when_role("assistant").alias("observations"),
        when_role("system").alias("service_requests"),
        F.when(F.col("role") == "system", F.lit("prompt")).alias("origin"),
    )
    arrival = F.struct(F.length("text").alias("n"), F.md5("text").alias("h"), F.col("role").alias("r"))
    return t.select(F.to_json(doc).alias("value"), arrival.alias("arrival"), "conv_id", "turn", "role")


_TURN = {
    "turn0": r"""SELECT conv_id, turn, role, text, list_filter(list_transform(string_split_regex(text, '[.\n]+'), lambda s: trim(s)), lambda s: s <> '') AS ss FROM conversations""",
    "bad": """SELECT conv_id, turn, 'item text length' AS rule FROM turn0 WHERE len(list_filter(ss, lambda s: length(s) > 500)) > 0
      UNION ALL SELECT conv_id, turn, 'no items' FROM turn0 WHERE len(ss) = 0
      UNION ALL SELECT conv_id, turn, 'unknown field origin' FROM turn0 WHERE role = 'system'""",
    "ok": "SELECT * FROM turn0 WHERE len(ss) > 0 AND role <> 'system' AND len(list_filter(ss, lambda s: length(s) > 500)) = 0",
}


@query("validate_encounters", with_ctes(extra=_TURN) + "SELECT conv_id, turn, rule FROM bad UNION ALL SELECT conv_id, turn, 'valid' FROM ok")
def validate_encounters(spark, sf):
    checked = C.validate_encounters(encounter_lines(spark, sf))
    good = C.accepted(checked).select("conv_id", "turn", F.lit("valid").alias("rule"))
    return C.quarantined(checked).select("conv_id", "turn", "rule").unionByName(good)


@query(
    "flatten_items",
    with_ctes(extra=_TURN)
    + """SELECT 'enc-' || conv_id || '-' || turn AS encounter_id, unnest(range(1, len(ss) + 1)) AS sequence, unnest(ss) AS text,
    CASE role WHEN 'user' THEN 'condition' ELSE 'observation' END AS item_type,
    CASE role WHEN 'user' THEN 'pending' ELSE 'not_coded' END AS status FROM ok""",
)
def flatten_items(spark, sf):
    encounters = C.accepted(C.validate_encounters(encounter_lines(spark, sf)))
    return C.flatten_items(encounters).select("encounter_id", "sequence", "text", "item_type", "status")


@query(
    "reject_duplicates",
    """WITH i AS (SELECT conv_id, 'enc-' || conv_id || '-' || turn AS encounter_id, role, length(text) AS n, md5(text) AS h FROM conversations),
    f AS (SELECT *, row_number() OVER (PARTITION BY encounter_id ORDER BY n, h, role) AS k FROM i)
    SELECT encounter_id, n, CASE WHEN encounter_id IN (SELECT encounter_id FROM i WHERE role = 'system') THEN 'already stored'
    WHEN k > 1 THEN 'repeated' END AS rejected FROM f""",
)
def reject_duplicates(spark, sf):
    """Every turn arrives; the system turns are stored already."""
    lines = encounter_lines(spark, sf).withColumn("encounter_id", F.concat_ws("-", F.lit("enc"), "conv_id", "turn"))
    out = C.reject_duplicates(lines, lines.where("role = 'system'"), "arrival")
    return out.select("encounter_id", F.col("arrival.n").alias("n"), "rejected")


@query("save_candidates")
def save_candidates(spark, sf):
    """Top hits of hybrid search for every condition of every valid encounter."""
    encounters = C.accepted(C.validate_encounters(encounter_lines(spark, sf)))
    items = P.with_item_ids(C.flatten_items(encounters.dropDuplicates(["encounter_id"])))
    saved = P.save_candidates(items, V.release(spark, sf), V.ENCODER, V.MODEL, V.DIMENSIONS, V.INSTRUCTION)
    return saved.withColumn("variants", F.array_join("variants", " "))


def _coded_batch(spark, sf):
    return P.code_encounters(
        encounter_lines(spark, sf).select("value"), V.release(spark, sf), V.ENCODER, V.MODEL, V.DIMENSIONS,
        {}, C.SEARCH_RANK, instruction=V.INSTRUCTION,
    )


@query("code_encounters")
def code_encounters(spark, sf):
    """The whole batch: intake, retrieval, scoring, assignment, routing."""
    return _coded_batch(spark, sf).encounters.select("encounter_id", "patient_id", "status", "review_queue")


@query("coding_events")
def coding_events(spark, sf):
    """The audit events that the batch itself emits."""
    return _coded_batch(spark, sf).events.select("encounter_id", "item_id", "action", "after")


# ── scoring over orders ──


@V.stored("scored-candidates")
def candidates(spark, sf):
    """Offered candidates: an order's parts that were not returned, dearest first."""
    parts = V.part_codes(spark, sf).select(F.col("p_partkey").alias("l_partkey"), "code", "p_name", "p_type", "p_size", "p_brand")
    table = V.table(spark, sf, "lineitem")
    lines = table.where("l_returnflag <> 'R'").select("l_orderkey", "l_partkey", "l_extendedprice", "l_linestatus")
    named = spread(lines.join(parts, "l_partkey"), table, "l_orderkey")
    offered = named.groupBy(F.col("l_orderkey").alias("item_id"), *parts.columns).agg(
        F.max("l_extendedprice").alias("price"), F.max(F.col("l_linestatus") == "O").alias("by_term")
    )
    display = F.concat_ws(" ", "p_name", F.lower("p_type"), F.lit("size"), F.col("p_size").cast("string"))
    term = F.concat_ws(" ", "p_name", F.lower("p_type"), F.lower("p_brand"))
    rank = F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("price"), "code"))
    return offered.withColumn("search_rank", rank).select(
        "item_id", "code", display.alias("display"), "search_rank", (F.col("price") / 10000).alias("search_score"),
        F.when(F.col("by_term"), term).alias("matched_on"),
    )


def engine_output(spark, sf):
    """What a scorer said: quantity shares of the taxed lines, returned parts included, and NOTA."""
    parts = V.part_codes(spark, sf).select(F.col("p_partkey").alias("l_partkey"), "code")
    table = V.table(spark, sf, "lineitem")
    lines = table.where("l_tax > 0").select(F.col("l_orderkey").alias("item_id"), "l_partkey", "l_quantity")
    # Null quantities count for nothing; an item of such lines alone has no total.
    said = spread(lines, table, "item_id").groupBy("item_id", "l_partkey").agg(F.sum("l_quantity").alias("w"))
    total = said.groupBy("item_id").agg((F.sum("w") + 10).alias("total"))
    shares = said.withColumn("total", F.sum("w").over(W.partitionBy("item_id")) + 10)
    scores = shares.where("item_id is not null").select("item_id", "l_partkey", (F.col("w") / F.col("total")).alias("probability"))
    return (
        scores.join(parts, "l_partkey").select("item_id", "code", "probability"),
        total.select("item_id", (F.lit(10.0) / F.col("total")).alias("nota_probability")),
    )


def orders(spark, sf):
    o = V.table(spark, sf, "orders")
    return o.select(
        F.col("o_orderkey").alias("item_id"), F.concat(F.lit("enc-"), F.col("o_custkey").cast("string")).alias("encounter_id"),
        F.col("o_orderkey").alias("sequence"), "o_orderstatus", "o_orderdate", "o_orderpriority",
    )


@V.stored("ranked-scores")
def ranked_scores(spark, sf):
    scores, nota = engine_output(spark, sf)
    table = V.table(spark, sf, "lineitem")
    offered = spread(candidates(spark, sf).select("item_id", "code", "search_rank"), table, "item_id")
    scores = spread(scores, table, "item_id")
    have = offered.select("item_id").distinct()
    all_nota = have.join(nota, "item_id", "left")
    return C.rank_scores(offered, C.closed_set_filter(scores, offered), all_nota)


_F3 = {
    "cand": """SELECT l_orderkey AS item_id, code, p_name || ' ' || lower(p_type) || ' size ' || p_size AS display,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY max(l_extendedprice) DESC, code) AS search_rank,
        max(l_extendedprice) / 10000 AS search_score,
        CASE WHEN bool_or(l_linestatus = 'O') THEN p_name || ' ' || lower(p_type) || ' ' || lower(p_brand) END AS matched_on
        FROM lineitem JOIN part_code ON p_partkey = l_partkey WHERE l_returnflag <> 'R'
        GROUP BY l_orderkey, l_partkey, code, p_name, p_type, p_size, p_brand""",
    "total": "SELECT l_orderkey AS item_id, sum(l_quantity) + 10 AS total FROM lineitem WHERE l_tax > 0 GROUP BY 1",
    "said": """SELECT l.l_orderkey AS item_id, code, sum(l_quantity) / any_value(total) AS probability FROM lineitem l
        JOIN part_code ON p_partkey = l_partkey JOIN total t ON t.item_id = l.l_orderkey WHERE l_tax > 0 GROUP BY l.l_orderkey, l_partkey, code""",
    "entry": """SELECT c.item_id, c.code, c.search_rank, coalesce(s.probability, 0) AS probability FROM cand c
        LEFT JOIN said s ON s.item_id = c.item_id AND s.code = c.code
        UNION ALL SELECT h.item_id, NULL, NULL, coalesce(10.0::DOUBLE / t.total, 0) FROM (SELECT DISTINCT item_id FROM cand) h LEFT JOIN total t ON t.item_id = h.item_id""",
    "ranked": "SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY probability DESC, code IS NULL, search_rank) AS rank FROM entry",
    "assigned": """SELECT item_id, min_by(code, rank) FILTER (WHERE code IS NOT NULL) AS assigned_code, max(probability) FILTER (WHERE code IS NOT NULL) AS probability,
        max(probability) FILTER (WHERE code IS NULL) AS nota_probability,
        bool_or(code IS NULL AND rank = 1 AND probability > 0) AS nota_first FROM ranked GROUP BY 1""",
    "flagged": """SELECT *, concat_ws(' ', CASE WHEN probability < 0.75 THEN 'LOW_CONFIDENCE' END,
        CASE WHEN nota_probability >= 0.2 OR nota_first THEN 'NONE_OF_THE_ABOVE' END) AS flags FROM assigned""",
    "item": """SELECT o_orderkey AS item_id, 'enc-' || o_custkey AS encounter_id, o_orderkey AS sequence, o_orderdate, o_orderstatus,
        CASE WHEN f.item_id IS NULL THEN 'no_candidates' WHEN o_orderpriority = '5-LOW' THEN 'failed' ELSE 'scored' END AS base_status,
        CASE WHEN o_orderpriority <> '5-LOW' OR f.item_id IS NULL THEN assigned_code END AS assigned_code, probability, nota_probability,
        CASE WHEN f.item_id IS NULL THEN 'NO_CANDIDATES' WHEN o_orderpriority = '5-LOW' THEN 'SCORING_FAILED' ELSE flags END AS flags
        FROM orders LEFT JOIN flagged f ON f.item_id = o_orderkey""",
    "state": """SELECT *, CASE WHEN base_status = 'scored' AND o_orderstatus = 'F' THEN 'approved' ELSE base_status END AS status,
        CASE WHEN base_status = 'scored' AND o_orderstatus = 'F' THEN assigned_code END AS final_code FROM item""",
    "enc": """SELECT encounter_id, CASE WHEN bool_or(flags <> '' OR base_status IN ('no_candidates', 'failed')) THEN 'close_review' ELSE 'standard' END AS review_queue,
        CASE WHEN bool_and(base_status = 'failed') THEN 'failed' ELSE 'ready_for_review' END AS status,
        bool_and(status = 'approved') AS is_human_reviewed, max(o_orderdate) AS created_at FROM state GROUP BY 1""",
}


def _f3(upto: str) -> str:
    return with_ctes("part_code", extra=dict(list(_F3.items())[: list(_F3).index(upto) + 1]))


@V.stored("item-states")
def item_states(spark, sf):
    """Orders as items after scoring: low-priority orders failed, finished orders are approved."""
    assigned = C.assign(spread(ranked_scores(spark, sf), V.table(spark, sf, "lineitem"), "item_id"))
    failed = F.col("o_orderpriority") == "5-LOW"
    none = F.col("nota_probability").isNull()
    base = F.when(none, "no_candidates").when(failed, "failed").otherwise("scored")
    flags = (
        F.when(none, F.array(F.lit(C.NO_CANDIDATES))).when(failed, F.array(F.lit(C.SCORING_FAILED))).otherwise(F.col("flags"))
    )
    approved = (F.col("base_status") == "scored") & (F.col("o_orderstatus") == "F")
    return (
        orders(spark, sf).join(assigned, "item_id", "left")
        .withColumn("base_status", base)
        .withColumn("assigned_code", F.when(~failed | none, F.col("assigned_code")))
        .withColumn("flags", flags)
        .withColumn("status", F.when(approved, "approved").otherwise(F.col("base_status")))
        .withColumn("final_code", F.when(approved, F.col("assigned_code")))
        .withColumn("item_type", F.lit("condition"))
        .withColumn("coded", F.lit(True))
    )


@V.stored("encounters")
def encounters(spark, sf):
    items = item_states(spark, sf)
    routed = C.review_queue(items.withColumn("status", F.col("base_status")))
    rest = items.groupBy("encounter_id").agg(
        F.bool_and(F.col("status") == "approved").alias("is_human_reviewed"), F.max("o_orderdate").alias("created_at")
    )
    return routed.join(rest, "encounter_id").withColumn("patient_id", F.regexp_replace("encounter_id", "enc", "pat"))


@query("mark_no_candidates", _f3("cand") + "SELECT o_orderkey AS item_id, 'no_candidates' AS status, 'NO_CANDIDATES' AS flags FROM orders WHERE o_orderkey NOT IN (SELECT item_id FROM cand)")
def mark_no_candidates(spark, sf):
    out = C.mark_no_candidates(orders(spark, sf), candidates(spark, sf))
    return out.select("item_id", "status", F.array_join("flags", " ").alias("flags"))


@query(
    "score_search_rank",
    _f3("cand") + "SELECT item_id, code, round(exp(-(search_rank - 1)) / sum(exp(-(search_rank - 1))) OVER (PARTITION BY item_id), 8) AS probability FROM cand",
)
def score_search_rank(spark, sf):
    return C.score_search_rank(candidates(spark, sf)).withColumn("probability", F.round("probability", 8))


def _decay_scorer():
    def score(note, text, options):
        if text == "5-LOW":
            raise RuntimeError("low priority is not scored")
        weights = {o["code"]: math.exp(1 - o["search_rank"]) for o in options}
        total = sum(weights.values()) + 0.1
        return {"model": "decay-v1", "probabilities": {c: w / total for c, w in weights.items()}, "nota_probability": 0.1 / total, "cost": 0.0}

    return score


def _decisions(spark, sf):
    items = orders(spark, sf).select("item_id", "encounter_id", F.col("o_orderpriority").alias("text"), F.lit("").alias("note"))
    return items, C.score_with(items, candidates(spark, sf), {"decay": _decay_scorer}, "decay")


@query(
    "score_with",
    _f3("cand") + """, w AS (SELECT item_id, sum(exp(1 - search_rank)) + 0.1 AS total, count(*) AS n FROM cand GROUP BY 1)
    SELECT item_id, CASE WHEN o_orderpriority = '5-LOW' THEN 'failed' ELSE 'succeeded' END AS status,
    CASE WHEN o_orderpriority <> '5-LOW' THEN round(0.1 / total, 8) END AS nota_probability,
    CASE WHEN o_orderpriority = '5-LOW' THEN 0 ELSE n END AS scored FROM w JOIN orders ON o_orderkey = item_id""",
)
def score_with(spark, sf):
    _, made = _decisions(spark, sf)
    return made.select("item_id", "status", F.round("nota_probability", 8).alias("nota_probability"), F.size("probabilities").alias("scored"))


@query(
    "isolate_failures",
    _f3("cand") + """SELECT o_orderkey AS item_id, 'failed' AS status, 'SCORING_FAILED' AS flags, 'decay: low priority is not scored' AS error,
    'item.scoring_failed' AS event FROM orders WHERE o_orderpriority = '5-LOW' AND o_orderkey IN (SELECT item_id FROM cand)""",
)
def isolate_failures(spark, sf):
    items, made = _decisions(spark, sf)
    out = C.isolate_failures(items, made)
    return out.select("item_id", "status", F.array_join("flags", " ").alias("flags"), "error", "event")


@query("closed_set_filter", _f3("said") + "SELECT s.item_id, s.code, round(s.probability, 8) AS probability FROM said s JOIN cand c ON c.item_id = s.item_id AND c.code = s.code")
def closed_set_filter(spark, sf):
    scores, _ = engine_output(spark, sf)
    return C.closed_set_filter(scores, candidates(spark, sf)).select("item_id", "code", F.round("probability", 8).alias("probability"))


@query("unknown_options", _f3("said") + "SELECT s.item_id, s.code FROM said s LEFT JOIN cand c ON c.item_id = s.item_id AND c.code = s.code WHERE c.code IS NULL")
def unknown_options(spark, sf):
    scores, _ = engine_output(spark, sf)
    return C.unknown_options(scores, candidates(spark, sf))


@query("rank_scores", _f3("ranked") + "SELECT item_id, code, round(probability, 8) AS probability, rank FROM ranked")
def rank_scores(spark, sf):
    return ranked_scores(spark, sf).select("item_id", "code", F.round("probability", 8).alias("probability"), "rank")


@query("assign", _f3("flagged") + "SELECT item_id, assigned_code, round(probability, 8) AS probability, round(nota_probability, 8) AS nota_probability, flags FROM flagged")
def assign(spark, sf):
    out = C.assign(ranked_scores(spark, sf))
    return out.select(
        "item_id", "assigned_code", F.round("probability", 8).alias("probability"),
        F.round("nota_probability", 8).alias("nota_probability"), F.array_join("flags", " ").alias("flags"),
    )


@query("review_queue", _f3("enc") + "SELECT encounter_id, review_queue FROM enc")
def review_queue(spark, sf):
    return C.review_queue(item_states(spark, sf).withColumn("status", F.col("base_status"))).select("encounter_id", "review_queue")


@query("finalize", _f3("enc") + "SELECT encounter_id, status FROM enc")
def finalize(spark, sf):
    return C.review_queue(item_states(spark, sf).withColumn("status", F.col("base_status"))).select("encounter_id", "status")


def decision_log(spark, sf):
    """Line items as scoring runs of their order: the part is the run, the ship date its time."""
    lines = V.table(spark, sf, "lineitem")
    run = F.concat_ws("-", F.lpad(F.col("l_linenumber").cast("string"), 3, "0"), F.lpad(F.col("l_partkey").cast("string"), 12, "0"), F.lpad(F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string"), 12, "0"))
    return lines.select(
        F.col("l_orderkey").alias("item_id"), run.alias("decision_id"), F.col("l_returnflag").alias("engine"),
        F.when(F.col("l_linestatus") == "F", "failed").otherwise("succeeded").alias("status"), F.col("l_shipdate").alias("at"),
        F.when(F.col("l_tax") == 0, F.col("l_discount")).alias("reported_cost"),
        F.when(F.col("l_returnflag") == "A", "open-free").otherwise("open").alias("model"),
        F.when(F.col("l_quantity") > 5, F.col("l_quantity") * 1000).alias("input_tokens"),
    )


_LOG = """SELECT l_orderkey AS item_id, lpad(CAST(l_linenumber AS VARCHAR), 3, '0') || '-' || lpad(CAST(l_partkey AS VARCHAR), 12, '0') || '-' || lpad(CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR), 12, '0') AS decision_id,
  l_returnflag AS engine, CASE WHEN l_linestatus = 'F' THEN 'failed' ELSE 'succeeded' END AS status, l_shipdate AS tm,
  CASE WHEN l_tax = 0 THEN l_discount END AS reported_cost, CASE WHEN l_returnflag = 'A' THEN 'open-free' ELSE 'open' END AS model,
  CASE WHEN l_quantity > 5 THEN l_quantity * 1000 END AS input_tokens FROM lineitem"""


@query("active_decision", f"WITH d AS ({_LOG}) SELECT item_id, max(decision_id) AS decision_id, max_by(engine, decision_id) AS engine, max_by(status, decision_id) AS status, count(*) AS runs FROM d GROUP BY 1")
def active_decision(spark, sf):
    return C.active_decision(decision_log(spark, sf)).select("item_id", "decision_id", "engine", "status", "runs")


def order_reviews(spark, sf):
    """Shipped lines as review actions on their order."""
    lines = V.table(spark, sf, "lineitem").where("l_linestatus = 'F'")
    parts = V.part_codes(spark, sf).select(F.col("p_partkey").alias("l_partkey"), F.col("code").alias("part_code"))
    action = F.when(F.col("l_returnflag") == "A", "approve").when(F.col("l_returnflag") == "N", "override").otherwise("remove")
    return lines.join(parts, "l_partkey").select(
        F.col("l_orderkey").alias("item_id"), F.col("l_shipdate").alias("at"), action.alias("action"),
        F.when(F.col("l_returnflag") == "N", F.col("part_code")).alias("code"), "l_linenumber", "l_partkey", "l_extendedprice",
    )


@query(
    "item_state",
    with_ctes("part_code", extra={
        "d": _LOG,
        "a": "SELECT item_id, max_by(engine, decision_id) AS engine, max_by(status, decision_id) AS status, max_by(tm, decision_id) AS decided_at, count(*) AS runs FROM d GROUP BY 1",
        "r": """SELECT l_orderkey AS item_id, l_shipdate AS tm, CASE l_returnflag WHEN 'A' THEN 'approve' WHEN 'N' THEN 'override' ELSE 'remove' END AS action,
                CASE WHEN l_returnflag = 'N' THEN code END AS code FROM lineitem JOIN part_code ON p_partkey = l_partkey WHERE l_linestatus = 'F'""",
        "l": "SELECT r.*, row_number() OVER (PARTITION BY r.item_id ORDER BY r.tm DESC, action DESC, r.code DESC NULLS LAST) AS k FROM r JOIN a ON a.item_id = r.item_id WHERE r.tm > a.decided_at",
    })
    + "SELECT a.item_id, engine, status, runs, l.action AS review_action, l.code AS review_code FROM a LEFT JOIN l ON l.item_id = a.item_id AND k = 1",
)
def item_state(spark, sf):
    return C.item_state(decision_log(spark, sf), order_reviews(spark, sf).select("item_id", "at", "action", "code"))


@query(
    "rescore",
    _f3("enc") + """SELECT i.item_id, count(*) AS scored FROM item i JOIN cand c ON c.item_id = i.item_id JOIN enc e ON e.encounter_id = i.encounter_id
    WHERE NOT e.is_human_reviewed GROUP BY 1""",
)
def rescore(spark, sf):
    items = item_states(spark, sf).select("item_id", "encounter_id", "status", F.lit("").alias("text"), F.lit("").alias("note"))
    made = C.rescore(items, candidates(spark, sf), encounters(spark, sf).where("is_human_reviewed"), {"decay": _decay_scorer}, "decay")
    return made.select("item_id", F.size("probabilities").alias("scored"))


@query(
    "decision_cost",
    f"""WITH d AS ({_LOG}), p AS (SELECT l_returnflag AS engine, max(l_discount) + 0.042 AS price FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1)
    SELECT d.engine, count(*) AS runs, count(CASE WHEN reported_cost IS NOT NULL OR model LIKE '%-free' OR input_tokens * price IS NOT NULL THEN 1 END) AS priced,
    round(sum(CASE WHEN reported_cost IS NOT NULL THEN reported_cost WHEN model LIKE '%-free' THEN 0 ELSE input_tokens * price / 1000000 END), 4) AS cost
    FROM d LEFT JOIN p ON p.engine = d.engine GROUP BY 1""",
)
def decision_cost(spark, sf):
    """Cost per engine; returned lines' engine has no list price."""
    prices = V.table(spark, sf, "lineitem").where("l_returnflag <> 'R'").groupBy(F.col("l_returnflag").alias("engine")).agg(
        (F.max("l_discount") + 0.042).alias("price_per_million")
    )
    out = C.decision_cost(decision_log(spark, sf), prices)
    return out.groupBy("engine").agg(F.count(F.lit(1)).alias("runs"), F.count("cost").alias("priced"), F.round(F.sum("cost"), 4).alias("cost"))


@query(
    "note_mentions",
    """WITH c AS (SELECT p_partkey, p_name || ' and ' || upper(p_name) || ' of ' || p_brand || ', ' || p_name AS note, p_name AS t FROM part)
    SELECT 'enc-' || p_partkey AS encounter_id, unnest([t, upper(t), t]) AS mention,
    unnest([0, length(t) + 5, length(note) - length(t)]) AS start FROM c""",
)
def note_mentions(spark, sf):
    """Part names inside a note that repeats them; the adjective alone is part of a longer match."""
    p = V.table(spark, sf, "part")
    note = F.concat("p_name", F.lit(" and "), F.upper("p_name"), F.lit(" of "), "p_brand", F.lit(", "), "p_name")
    notes = p.select(
        F.concat(F.lit("enc-"), F.col("p_partkey").cast("string")).alias("encounter_id"), note.alias("note"),
        F.array(F.split("p_name", " ")[0], F.col("p_name"), F.lit(" a ")).alias("texts"),
    )
    return C.note_mentions(notes)


# ── review ──


@query(
    "list_encounters",
    _f3("enc") + """, c AS (SELECT encounter_id, count(*) AS items, count(*) FILTER (WHERE flags <> '') AS flagged_items FROM state GROUP BY 1)
    SELECT e.encounter_id, e.created_at, c.items, c.flagged_items, count(*) OVER () AS total FROM enc e JOIN c ON c.encounter_id = e.encounter_id
    WHERE review_queue = 'close_review' AND NOT is_human_reviewed ORDER BY e.created_at DESC, e.encounter_id DESC LIMIT 50 OFFSET 20""",
)
def list_encounters(spark, sf):
    out = RV.list_encounters(encounters(spark, sf), item_states(spark, sf), "close_review", None, False, 50, 20)
    return out.select("encounter_id", "created_at", "items", "flagged_items", "total")


@query(
    "queue_counts",
    _f3("enc") + """SELECT count(*) FILTER (WHERE NOT is_human_reviewed AND review_queue = 'standard') AS awaiting,
    count(*) FILTER (WHERE NOT is_human_reviewed AND review_queue = 'close_review') AS close_review,
    count(*) FILTER (WHERE is_human_reviewed) AS reviewed, count(*) FILTER (WHERE status = 'failed') AS failed FROM enc""",
)
def queue_counts(spark, sf):
    return RV.queue_counts(encounters(spark, sf))


@query(
    "top_alternatives",
    _f3("ranked") + """, a AS (SELECT item_id, min_by(code, rank) AS assigned_code FROM ranked WHERE code IS NOT NULL GROUP BY 1),
    t AS (SELECT r.item_id, r.code, round(probability, 6) AS probability, search_rank, row_number() OVER (PARTITION BY r.item_id ORDER BY rank) AS place
    FROM ranked r JOIN a ON a.item_id = r.item_id WHERE r.code IS NOT NULL AND r.code <> a.assigned_code)
    SELECT item_id, place, code, probability, search_rank FROM t WHERE place <= 15""",
)
def top_alternatives(spark, sf):
    ranked = ranked_scores(spark, sf)
    return RV.top_alternatives(C.assign(ranked), ranked)


@query(
    "billing_codes",
    _f3("enc") + """SELECT s.encounter_id, coalesce(string_agg(CASE WHEN e.is_human_reviewed THEN CASE WHEN s.status = 'approved' THEN final_code END
    WHEN s.status IN ('scored', 'approved') THEN coalesce(final_code, assigned_code) END, ' ' ORDER BY sequence), '') AS codes
    FROM state s JOIN enc e ON e.encounter_id = s.encounter_id GROUP BY 1""",
)
def billing_codes(spark, sf):
    out = RV.billing_codes(encounters(spark, sf), item_states(spark, sf))
    return out.select("encounter_id", F.array_join("billing_codes", " ").alias("codes"))


@query(
    "item_candidates",
    _f3("state") + """SELECT c.item_id, c.code, search_rank, round(search_score, 6) AS search_score, c.matched_on, round(r.probability, 6) AS probability, r.rank AS probability_rank,
    coalesce(c.code = s.assigned_code, FALSE) AS is_assigned, coalesce(c.code = s.final_code, FALSE) AS is_final
    FROM cand c JOIN state s ON s.item_id = c.item_id LEFT JOIN (SELECT item_id, code, probability, rank FROM ranked) r
    ON r.item_id = c.item_id AND r.code = c.code AND s.base_status = 'scored'""",
)
def item_candidates(spark, sf):
    offered = candidates(spark, sf).drop("display")
    states = item_states(spark, sf).select("item_id", "base_status", "assigned_code", "final_code")
    placed, items, ranked = (spread(t, offered, "item_id") for t in (offered, states, ranked_scores(spark, sf).where("code is not null")))
    ranked = ranked.join(items.where("base_status = 'scored'").select("item_id"), "item_id", "left_semi")
    return RV.item_candidates(items, placed, ranked)


@query(
    "filter_candidates",
    _f3("ranked") + """SELECT c.item_id, c.code, r.rank AS probability_rank FROM cand c JOIN ranked r ON r.item_id = c.item_id AND r.code = c.code
    WHERE contains(lower(c.code), 'ring') OR contains(lower(display), 'ring') OR contains(lower(coalesce(matched_on, '')), 'ring')""",
)
def filter_candidates(spark, sf):
    from termweave.operators.ranking import filter_candidates as browse

    ranks = ranked_scores(spark, sf).where("code is not null").select("item_id", "code", F.col("rank").alias("probability_rank"))
    shown = candidates(spark, sf).join(ranks, ["item_id", "code"], "left")
    return browse(shown, " Ring ", by_probability=True).select("item_id", "code", "probability_rank")


@V.stored("review-events")
def review_events(spark, sf):
    """Scoring results, reviews and approval attempts in time order per encounter."""
    owner = orders(spark, sf).select("item_id", "encounter_id")
    items = item_states(spark, sf)
    none = F.lit(None).cast("string")
    zero = F.lit(0).cast("bigint")
    scored = items.select("encounter_id", "item_id", F.col("o_orderdate").alias("ts"), F.lit(0).alias("o"), F.col("base_status").alias("kind"),
                          F.col("assigned_code").alias("code"), F.lit("system").alias("actor"), zero.alias("a"), zero.alias("b"), F.lit(0.0).alias("c"))
    reviews = order_reviews(spark, sf).join(owner, "item_id").select(
        "encounter_id", "item_id", F.col("at").alias("ts"), F.lit(1).alias("o"), F.col("action").alias("kind"), "code", F.lit("coder").alias("actor"),
        F.col("l_linenumber").cast("bigint").alias("a"), F.col("l_partkey").alias("b"), F.col("l_extendedprice").alias("c"))
    again = items.where("o_orderstatus = 'P'").select("encounter_id", "item_id", F.date_add("o_orderdate", 900).cast("timestamp").alias("ts"), F.lit(0).alias("o"),
                          F.col("base_status").alias("kind"), F.col("assigned_code").alias("code"), F.lit("system").alias("actor"), zero.alias("a"), zero.alias("b"), F.lit(0.0).alias("c"))
    attempts = items.select("encounter_id", F.lit(None).cast("bigint").alias("item_id"), F.date_add("o_orderdate", 2000).cast("timestamp").alias("ts"), F.lit(2).alias("o"),
                            F.lit(RV.APPROVAL).alias("kind"), none.alias("code"), F.lit("coder").alias("actor"), F.col("item_id").alias("a"), zero.alias("b"), F.lit(0.0).alias("c"))
    every = scored.unionByName(reviews).unionByName(again).unionByName(attempts)
    order = W.partitionBy("encounter_id").orderBy("ts", "o", "item_id", "a", "b", "c")
    return every.withColumn("seq", F.row_number().over(order)).drop("o", "a", "b", "c")


_EVENTS = {
    "ev0": """SELECT encounter_id, item_id, o_orderdate AS ts, 0 AS o, base_status AS kind, assigned_code AS code, 0 AS a, 0 AS b, 0.0 AS c FROM state
      UNION ALL SELECT 'enc-' || o_custkey, l_orderkey, l_shipdate, 1, CASE l_returnflag WHEN 'A' THEN 'approve' WHEN 'N' THEN 'override' ELSE 'remove' END,
        CASE WHEN l_returnflag = 'N' THEN p.code END, l_linenumber, l_partkey, l_extendedprice
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part_code p ON p_partkey = l_partkey WHERE l_linestatus = 'F'
      UNION ALL SELECT encounter_id, item_id, o_orderdate + INTERVAL 900 DAY, 0, base_status, assigned_code, 0, 0, 0 FROM state WHERE o_orderstatus = 'P'
      UNION ALL SELECT encounter_id, NULL, o_orderdate + INTERVAL 2000 DAY, 2, 'encounter.approve', NULL, item_id, 0, 0 FROM state""",
    "ev": "SELECT encounter_id, item_id, kind, code, ts, row_number() OVER (PARTITION BY encounter_id ORDER BY ts, o, item_id NULLS FIRST, a, b, c) AS seq FROM ev0",
    "ev1": """SELECT *, (SELECT max_by(s.code, s.seq) FROM ev s WHERE s.item_id = ev.item_id AND s.seq < ev.seq AND s.kind IN ('scored', 'failed', 'no_candidates') AND s.code IS NOT NULL
        AND s.seq = (SELECT max(z.seq) FROM ev z WHERE z.item_id = ev.item_id AND z.seq < ev.seq AND z.kind IN ('scored', 'failed', 'no_candidates'))) AS assigned,
        EXISTS (SELECT 1 FROM ev s WHERE s.item_id = ev.item_id AND s.seq < ev.seq AND s.kind IN ('scored', 'failed', 'no_candidates')) AS was_scored FROM ev""",
    "ev2": """SELECT *, CASE WHEN kind NOT IN ('approve', 'override', 'remove') THEN NULL WHEN NOT was_scored THEN 'pending'
        WHEN kind = 'approve' AND assigned IS NULL THEN 'nothing to approve' END AS broken FROM ev1""",
    "st": """SELECT encounter_id, item_id, seq, CASE WHEN kind IN ('scored', 'failed', 'no_candidates') THEN 0 ELSE 1 END AS st FROM ev2
        WHERE item_id IS NOT NULL AND broken IS NULL""",
    "dl": "SELECT *, st - coalesce(lag(st) OVER (PARTITION BY item_id ORDER BY seq), 0) AS delta FROM st",
    "needed": "SELECT encounter_id, count(*) AS needed FROM state GROUP BY 1",
    "ev3": """SELECT e.*, sum(coalesce(d.delta, 0)) OVER (PARTITION BY e.encounter_id ORDER BY e.seq) AS resolved, n.needed FROM ev2 e
        LEFT JOIN dl d ON d.encounter_id = e.encounter_id AND d.seq = e.seq JOIN needed n ON n.encounter_id = e.encounter_id""",
    "closed": "SELECT encounter_id, min(seq) AS closed_at FROM ev3 WHERE kind = 'encounter.approve' AND resolved = needed GROUP BY 1",
    "replay": """SELECT e.*, closed_at, CASE WHEN e.seq > closed_at THEN 'already approved' WHEN broken IS NOT NULL THEN broken
        WHEN kind = 'encounter.approve' AND resolved <> needed THEN 'items still need review' END AS reason
        FROM ev3 e LEFT JOIN closed c ON c.encounter_id = e.encounter_id""",
}


def _replay_sql() -> str:
    return with_ctes("part_code", extra={**_F3, **_EVENTS})


@V.stored("replayed-reviews")
def replayed(spark, sf):
    billable = V.concepts(spark, sf).where("is_billable").select("code")
    return RV.apply_reviews(
        item_states(spark, sf).select("encounter_id", "item_id", "coded"), review_events(spark, sf), billable, candidates(spark, sf)
    )


@query("apply_reviews", _replay_sql() + "SELECT encounter_id, item_id, seq, kind, reason IS NULL AS accepted, reason FROM replay")
def apply_reviews(spark, sf):
    return replayed(spark, sf).select("encounter_id", "item_id", "seq", "kind", "accepted", "reason")


@query(
    "review_state",
    _replay_sql() + """, t AS (SELECT * FROM replay WHERE reason IS NULL AND item_id IS NOT NULL)
    SELECT item_id, CASE max_by(kind, seq) WHEN 'approve' THEN 'approved' WHEN 'override' THEN 'overridden' WHEN 'remove' THEN 'removed' ELSE max_by(kind, seq) END AS status,
    CASE max_by(kind, seq) WHEN 'approve' THEN max_by(coalesce(assigned, ''), seq) WHEN 'override' THEN max_by(coalesce(code, ''), seq) END AS final_code FROM t GROUP BY 1""",
)
def review_state(spark, sf):
    return RV.review_state(replayed(spark, sf), item_states(spark, sf)).select("item_id", "status", "final_code")


@query(
    "approve_encounters",
    _f3("enc") + """, u AS (SELECT encounter_id, count(*) FILTER (WHERE status <> 'approved') AS unresolved, count(final_code) AS billed FROM state GROUP BY 1)
    SELECT e.encounter_id, unresolved, billed, CASE WHEN is_human_reviewed THEN 'already approved' WHEN unresolved > 0 THEN 'items still need review' END AS reason,
    NOT is_human_reviewed AND unresolved = 0 AS allowed FROM enc e JOIN u ON u.encounter_id = e.encounter_id""",
)
def approve_encounters(spark, sf):
    return RV.approve_encounters(encounters(spark, sf), item_states(spark, sf))


def review_outcome(spark, sf):
    """Items after the replayed reviews, and their encounters as they stand before an approval."""
    states = RV.review_state(replayed(spark, sf), item_states(spark, sf)).join(item_states(spark, sf).select("item_id", "sequence"), "item_id")
    return encounters(spark, sf).withColumn("is_human_reviewed", F.col("review_queue") == "standard"), states


@query(
    "approval_items",
    _replay_sql() + """, t AS (SELECT * FROM replay WHERE reason IS NULL AND item_id IS NOT NULL),
    r AS (SELECT item_id, max_by(kind, seq) AS kind, nullif(CASE max_by(kind, seq) WHEN 'approve' THEN max_by(coalesce(assigned, ''), seq) WHEN 'override' THEN max_by(coalesce(code, ''), seq) END, '') AS final_code FROM t GROUP BY 1),
    z AS (SELECT s.encounter_id, s.sequence, s.item_id, coalesce(CASE kind WHEN 'approve' THEN 'approved' WHEN 'override' THEN 'overridden' WHEN 'remove' THEN 'removed' ELSE kind END, 'pending') AS status, r.final_code
        FROM state s LEFT JOIN r ON r.item_id = s.item_id),
    g AS (SELECT encounter_id, count(*) FILTER (WHERE status NOT IN ('approved', 'overridden', 'removed')) = 0 AS allowed FROM z GROUP BY 1)
    SELECT z.encounter_id, allowed, sequence, item_id, z.status, CASE WHEN allowed THEN final_code END AS final_code
    FROM z JOIN g ON g.encounter_id = z.encounter_id JOIN enc e ON e.encounter_id = z.encounter_id
    WHERE e.review_queue <> 'standard' AND CASE WHEN allowed THEN final_code IS NOT NULL ELSE z.status NOT IN ('approved', 'overridden', 'removed') END""",
)
def approval_items(spark, sf):
    """After all reviews; the encounters of the standard queue count as approved already."""
    return RV.approval_items(*review_outcome(spark, sf))


def audit(spark, sf):
    items = item_states(spark, sf)
    outcomes = items.select("encounter_id", "item_id", F.col("base_status").alias("kind"), F.to_json(F.struct("assigned_code", "flags"), {"ignoreNullFields": "false"}).alias("payload"))
    return RV.audit_events(items, outcomes, replayed(spark, sf), encounters(spark, sf))


@query(
    "audit_events",
    _replay_sql() + """SELECT action, count(*) AS n FROM (
    SELECT 'encounter.received' AS action FROM needed UNION ALL SELECT 'encounter.processed' FROM needed
    UNION ALL SELECT 'item.' || base_status FROM state
    UNION ALL SELECT CASE WHEN kind = 'encounter.approve' THEN 'encounter.approved' ELSE 'item.' || kind END FROM replay
    WHERE reason IS NULL AND kind NOT IN ('scored', 'failed', 'no_candidates')) GROUP BY 1""",
)
def audit_events(spark, sf):
    return audit(spark, sf).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query(
    "audit_trail",
    _replay_sql() + """, t AS (SELECT *, CASE kind WHEN 'approve' THEN 'approved' WHEN 'override' THEN 'overridden' WHEN 'remove' THEN 'removed' ELSE kind END AS status,
        CASE kind WHEN 'approve' THEN assigned WHEN 'override' THEN code END AS final_code FROM replay WHERE reason IS NULL AND item_id IS NOT NULL),
    b AS (SELECT *, coalesce(lag(status) OVER w, 'pending') AS was, lag(final_code) OVER w AS had FROM t WINDOW w AS (PARTITION BY item_id ORDER BY seq)),
    f AS (SELECT encounter_id, item_id, max_by(kind, seq) AS kind, max_by(coalesce(final_code, ''), seq) AS code FROM t GROUP BY 1, 2),
    fc AS (SELECT encounter_id, list(code ORDER BY item_id) AS codes FROM f WHERE kind IN ('approve', 'override') AND code <> '' GROUP BY 1),
    a AS (SELECT encounter_id, NULL AS item_id, 'encounter.received' AS action, NULL AS before, '{"items":{"condition":' || needed || '},"coded_item_types":["condition"]}' AS after, 0 AS stage, 0 AS at FROM needed
      UNION ALL SELECT encounter_id, item_id, 'item.' || base_status, NULL, json_object('assigned_code', assigned_code, 'flags', string_split_regex(flags, ' '))::VARCHAR, 1, 0 FROM state WHERE flags <> ''
      UNION ALL SELECT encounter_id, item_id, 'item.' || base_status, NULL, json_object('assigned_code', assigned_code, 'flags', []::VARCHAR[])::VARCHAR, 1, 0 FROM state WHERE flags = ''
      UNION ALL SELECT encounter_id, NULL, 'encounter.processed', NULL, json_object('status', status, 'review_queue', review_queue)::VARCHAR, 2, 0 FROM enc
      UNION ALL SELECT b.encounter_id, b.item_id, 'item.' || kind, json_object('status', was, 'final_code', had, 'assigned_code', assigned)::VARCHAR,
        CASE WHEN kind = 'override' THEN json_object('final_code', final_code, 'in_candidates', c.code IS NOT NULL) ELSE json_object('final_code', final_code) END::VARCHAR, 3, seq
        FROM b LEFT JOIN cand c ON c.item_id = b.item_id AND c.code = b.final_code WHERE kind NOT IN ('scored', 'failed', 'no_candidates')
      UNION ALL SELECT r.encounter_id, NULL, 'encounter.approved', NULL, json_object('final_billing_codes', coalesce(codes, []::VARCHAR[]))::VARCHAR, 3, seq
        FROM replay r LEFT JOIN fc ON fc.encounter_id = r.encounter_id WHERE kind = 'encounter.approve' AND reason IS NULL)
    SELECT *, row_number() OVER (PARTITION BY encounter_id ORDER BY stage, a."at", item_id NULLS FIRST, action) AS position FROM a""",
)
def audit_trail(spark, sf):
    """The trail of every encounter."""
    return RV.audit_trail(audit(spark, sf), encounters(spark, sf))


@query(
    "retrieval_misses",
    _replay_sql() + """SELECT o_orderpriority, count(*) AS overrides, count(*) FILTER (WHERE c.code IS NULL) AS misses,
    round(count(*) FILTER (WHERE c.code IS NULL) / CAST(count(*) AS DOUBLE), 6) AS miss_rate
    FROM replay r JOIN orders ON o_orderkey = r.item_id LEFT JOIN cand c ON c.item_id = r.item_id AND c.code = r.code
    WHERE reason IS NULL AND kind = 'override' GROUP BY 1""",
)
def retrieval_misses(spark, sf):
    """By order priority."""
    priority = orders(spark, sf).select("item_id", "o_orderpriority")
    return RV.retrieval_misses(replayed(spark, sf).join(priority, "item_id"), ["o_orderpriority"]).withColumn("miss_rate", F.round("miss_rate", 6))


@query("encounter_document")
def encounter_document(spark, sf):
    items = item_states(spark, sf)
    ranked = ranked_scores(spark, sf)
    docs = RV.encounter_document(
        encounters(spark, sf), items, RV.top_alternatives(items, ranked), RV.billing_codes(encounters(spark, sf), items)
    )
    return docs.select("encounter_id", "patient_id", "status", "review_queue", F.to_json("coded_concepts").alias("coded_concepts"), F.to_json("audit_trail").alias("audit_trail"))


@query(
    "encounter_record",
    _f3("enc") + """, own AS (SELECT item_id, count(*) AS n FROM cand GROUP BY 1),
    alt AS (SELECT r.item_id, r.code, r.probability, r.search_rank, c.display, c.matched_on, row_number() OVER (PARTITION BY r.item_id ORDER BY rank) AS place
        FROM ranked r JOIN cand c ON c.item_id = r.item_id AND c.code = r.code JOIN state s ON s.item_id = r.item_id WHERE r.code IS DISTINCT FROM s.assigned_code),
    alts AS (SELECT item_id, string_agg(concat_ws('~', place, code, display, round(probability, 6)::DECIMAL(12, 6), search_rank, coalesce(matched_on, '-')), ';' ORDER BY place) AS alts FROM alt WHERE place <= 15 GROUP BY 1),
    shown AS (SELECT s.*, row_number() OVER (PARTITION BY encounter_id ORDER BY sequence) - 1 AS pos, o.o_orderpriority AS text FROM state s JOIN orders o ON o.o_orderkey = s.item_id),
    line AS (SELECT encounter_id, pos // 5 AS page, pos, concat_ws('|', sequence, s.item_id, 'condition', text, o_orderstatus, status, CASE WHEN base_status = 'failed' THEN 'not scored' ELSE '-' END,
          CASE WHEN base_status = 'scored' THEN concat_ws('|', 'decay', 'decay-v1', s.assigned_code, c.display, round(probability, 6)::DECIMAL(12, 6), round(nota_probability, 6)::DECIMAL(12, 6), flags, coalesce(alts, ''), n) ELSE '-' END,
          CASE WHEN status = 'approved' THEN concat_ws('|', 'approve', final_code, c.display, 'coder') ELSE '-' END) AS line,
        final_code, CASE WHEN status IN ('scored', 'approved') THEN assigned_code END AS open_code
        FROM shown s LEFT JOIN cand c ON c.item_id = s.item_id AND c.code = s.assigned_code LEFT JOIN alts ON alts.item_id = s.item_id LEFT JOIN own ON own.item_id = s.item_id)
    SELECT l.encounter_id, l.page::INT AS page, replace(l.encounter_id, 'enc', 'pat') AS patient_id, any_value(e.status) AS status, any_value(e.review_queue) AS review_queue,
      'note of ' || l.encounter_id AS soap_note, md5(string_agg(line, chr(10) ORDER BY pos)) AS items,
      coalesce(string_agg(CASE WHEN e.is_human_reviewed THEN final_code ELSE open_code END, ' ' ORDER BY pos), '') AS codes
    FROM line l JOIN enc e ON e.encounter_id = l.encounter_id GROUP BY 1, 2""",
)
def encounter_record(spark, sf):
    """Whole records in pages of five items; the items of a page as one digest of their fields."""
    offered = candidates(spark, sf)
    states = item_states(spark, sf)
    named = offered.select("item_id", F.col("code").alias("assigned_code"), F.col("display").alias("assigned_display"))
    approved = F.col("status") == "approved"
    items = states.join(named, ["item_id", "assigned_code"], "left").withColumns({
        "text": F.col("o_orderpriority"), "details": F.col("o_orderstatus"), "error": F.when(F.col("base_status") == "failed", "not scored"),
        "final_display": F.when(approved, F.col("assigned_display")), "review_action": F.when(approved, "approve"),
        "reviewed_by": F.when(approved, "coder"), "reviewed_at": F.when(approved, F.col("o_orderdate")),
    })
    decided = states.where("base_status <> 'no_candidates'").select("item_id", F.when(F.col("base_status") == "scored", "succeeded").otherwise("failed").alias("status"))
    decisions = decided.join(offered.groupBy("item_id").agg(F.count(F.lit(1)).alias("candidates_scored")), "item_id").withColumns(
        {"engine": F.lit("decay"), "model": F.lit("decay-v1"), "latency_ms": F.lit(None).cast("double")}
    )
    texts = offered.select("item_id", "code", "display", "matched_on")
    alternatives = RV.top_alternatives(states, ranked_scores(spark, sf)).join(texts, ["item_id", "code"])
    heads = encounters(spark, sf).withColumns({
        "soap_note": F.concat(F.lit("note of "), "encounter_id"), "department": F.lit(None).cast("string"),
        "reviewed_by": F.when(F.col("is_human_reviewed"), "coder"), "reviewed_at": F.when(F.col("is_human_reviewed"), F.col("created_at")),
    })

    def six(c):
        return c.cast("decimal(12,6)").cast("string")

    def classified(ai):
        others = F.transform(ai["top_alternatives"], lambda x: F.concat_ws(
            "~", x["place"].cast("string"), x["code"], x["display"], six(x["probability"]), x["search_rank"].cast("string"), F.coalesce(x["matched_on"], F.lit("-"))))
        return F.when(ai.isNotNull(), F.concat_ws(
            "|", ai["engine"], ai["model"], ai["assigned_code"], ai["assigned_description"], six(ai["probability"]),
            six(ai["none_of_the_above_probability"]), F.array_join(ai["flags"], " "), F.array_join(others, ";"), ai["candidates_scored"].cast("string"))).otherwise("-")

    def reviewed(r):
        return F.when(r["action"].isNotNull(), F.concat_ws("|", r["action"], r["final_code"], r["final_description"], r["reviewed_by"])).otherwise("-")

    lines = F.transform("coded_concepts", lambda i: F.concat_ws(
        "|", i["sequence"].cast("string"), i["item_id"].cast("string"), i["item_type"], i["text"], i["details"], i["status"],
        F.coalesce(i["error"], F.lit("-")), classified(i["ai_classification"]), reviewed(i["review"])))
    return RV.encounter_record(heads, items, decisions, alternatives, page_size=5).select(
        "encounter_id", "page", "patient_id", "status", "review_queue", "clinical_input.soap_note",
        F.md5(F.array_join(lines, "\n")).alias("items"), F.array_join("audit_trail.final_billing_codes", " ").alias("codes"),
    )


@query(
    "final_code_misses",
    _f3("state") + "SELECT s.encounter_id, s.item_id, s.final_code AS code FROM state s JOIN lineitem l ON l.l_orderkey = s.item_id AND FALSE "
    "UNION ALL SELECT 'enc-' || o_custkey, l_orderkey, p.code FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part_code p ON p_partkey = l_partkey "
    "LEFT JOIN cand c ON c.item_id = l_orderkey AND c.code = p.code WHERE c.code IS NULL",
)
def final_code_misses(spark, sf):
    """Every line as a reviewer's final code: the returned parts were never offered."""
    parts = V.part_codes(spark, sf).select(F.col("p_partkey").alias("l_partkey"), F.col("code").alias("final_code"))
    finals = V.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("item_id"), "l_partkey").join(parts, "l_partkey")
    finals = finals.join(orders(spark, sf).select("item_id", "encounter_id"), "item_id")
    return RV.final_code_misses(finals, candidates(spark, sf))
