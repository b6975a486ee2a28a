"""Review, billing and audit (V-01..V-11).

Review history is replayed without collecting it: whether an item is resolved depends only on
its own earlier events (a window per item), and an encounter can be approved at the first
attempt at which the running number of resolved items equals its coded items (a window per
encounter). Everything after that attempt is refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from termweave.functions.codes import to_dotted
from termweave.operators.coding import CODED_TYPES
from termweave.session import folded_join, numbered, spread

SCORING = ("scored", "failed", "no_candidates")
REVIEWS = ("approve", "override", "remove")
APPROVAL = "encounter.approve"
RESOLVED = {"approve": "approved", "override": "overridden", "remove": "removed"}
ALREADY = "already approved"
NEEDS_REVIEW = "items still need review"
UNRESOLVED = ("pending", "scored", "no_candidates", "failed")


def list_encounters(
    encounters: DataFrame,
    items: DataFrame,
    queue: str | None = None,
    status: str | None = None,
    reviewed: bool | None = None,
    limit: int = 50,
    offset: int = 0,
) -> DataFrame:
    """V-01: one page of encounters, newest first, with item counts and the exact total."""
    chosen = encounters
    for column, value in (("review_queue", queue), ("status", status), ("is_human_reviewed", reviewed)):
        if value is not None:
            chosen = chosen.where(F.col(column) == value)
    total = chosen.agg(F.count(F.lit(1)).alias("total")).withColumn("_one", F.lit(1))
    page = (
        chosen.orderBy(F.desc("created_at"), F.desc("encounter_id")).offset(offset).limit(limit).withColumn("_one", F.lit(1))
    )
    counts = (
        items.join(page.select("encounter_id"), "encounter_id", "left_semi")
        .groupBy("encounter_id")
        .agg(F.count(F.lit(1)).alias("items"), F.count_if(F.size("flags") > 0).alias("flagged_items"))
    )
    return (
        page.join(counts, "encounter_id", "left").fillna(0, ["items", "flagged_items"])
        .join(total, "_one").drop("_one")
        .orderBy(F.desc("created_at"), F.desc("encounter_id"))
    )


def queue_counts(encounters: DataFrame) -> DataFrame:
    """V-02: the dashboard's four numbers in one pass."""
    open_ = ~F.col("is_human_reviewed")
    return encounters.agg(
        F.count_if(open_ & (F.col("review_queue") == "standard")).alias("awaiting"),
        F.count_if(open_ & (F.col("review_queue") == "close_review")).alias("close_review"),
        F.count_if(F.col("is_human_reviewed")).alias("reviewed"),
        F.count_if(F.col("status") == "failed").alias("failed"),
    )


def top_alternatives(items: DataFrame, ranked: DataFrame, shown: int = 15) -> DataFrame:
    """V-04: per item the best real candidates of the active decision without the assigned code."""
    others = (
        ranked.where("code is not null")
        .join(items.select("item_id", "assigned_code"), "item_id")
        .where(~F.col("code").eqNullSafe(F.col("assigned_code")))
    )
    order = W.partitionBy("item_id").orderBy("rank")
    return (
        others.withColumn("place", F.row_number().over(order)).where(F.col("place") <= shown)
        .select("item_id", "place", "code", F.round("probability", 6).alias("probability"), "search_rank")
    )


def billing_codes(encounters: DataFrame, items: DataFrame) -> DataFrame:
    """V-05: final codes of an approved encounter, or the preview of an open one, in item order."""
    final = F.col("status").isin("approved", "overridden")
    code = F.when(F.col("is_human_reviewed"), F.when(final, F.col("final_code"))).otherwise(
        F.when(final | (F.col("status") == "scored"), F.coalesce("final_code", "assigned_code"))
    )
    billed = items.join(encounters.select("encounter_id", "is_human_reviewed"), "encounter_id").withColumn("bill", code)
    ordered = F.sort_array(F.collect_list(F.when(F.col("bill").isNotNull(), F.struct("sequence", "bill"))))
    return billed.groupBy("encounter_id").agg(F.transform(ordered, lambda x: x["bill"]).alias("billing_codes"))


def item_candidates(items: DataFrame, candidates: DataFrame, ranked: DataFrame) -> DataFrame:
    """V-06: stored candidates in search order with the active probability and rank.

    `ranked` holds the ranks of succeeded active decisions only; other items show NULL. `candidates` may lack what is
    not to be shown. Tables that are placed by item alike stay where they are.
    """
    texts = [c for c in ("display", "search_rank", "search_score", "matched_on") if c in candidates.columns]
    scores = ranked.where("code is not null").select("item_id", "code", "probability", F.col("rank").alias("probability_rank"))
    offered = candidates.where("item_id is not null").select("item_id", "code", *texts)
    rounded_score = {"search_score": F.round("search_score", 6).alias("search_score")}
    return (
        folded_join(offered, scores, ["item_id", "code"])
        .join(items.select("item_id", "assigned_code", "final_code"), "item_id")
        .select(
            "item_id", "code", *[rounded_score.get(c, F.col(c)) for c in texts],
            F.round("probability", 6).alias("probability"), "probability_rank",
            F.coalesce(F.col("code") == F.col("assigned_code"), F.lit(False)).alias("is_assigned"),
            F.coalesce(F.col("code") == F.col("final_code"), F.lit(False)).alias("is_final"),
        )
    )


def final_code_misses(items: DataFrame, candidates: DataFrame) -> DataFrame:
    """V-06: final codes that search never offered."""
    finals = items.where("final_code is not null").select("encounter_id", "item_id", F.col("final_code").alias("code"))
    return finals.join(candidates.select("item_id", "code"), ["item_id", "code"], "left_anti")


def with_dotted_overrides(events: DataFrame) -> DataFrame:
    """Review events whose override codes have the stored form; a blank code is none."""
    typed = to_dotted(F.col("code"))
    return events.withColumn("code", F.when(F.col("kind") == "override", F.when(typed != "", typed)).otherwise(F.col("code")))


def apply_reviews(items: DataFrame, events: DataFrame, billable: DataFrame, candidates: DataFrame) -> DataFrame:
    """V-07 and V-08 over history: every event with `accepted`, `reason`, `resolved` and what it sets.

    items: encounter_id, item_id, coded. events: encounter_id, item_id (NULL for an approval),
    seq (total order), kind, code, actor. billable: code. candidates: item_id, code.
    The code of an override may come undotted and in lower case.

    Codes are looked up for overrides alone and items for events that name one, so events without are not
    gathered under a null key. All is then placed by encounter once.
    """
    e = with_dotted_overrides(events)
    override = F.coalesce(F.col("kind") == "override", F.lit(False)) & F.col("item_id").isNotNull()
    unknown = F.lit(None).cast("boolean")
    asked = (
        e.where(override).join(billable.select("code").distinct().withColumn("is_billable", F.lit(True)), "code", "left")
        .join(candidates.select("item_id", "code").distinct().withColumn("in_candidates", F.lit(True)), ["item_id", "code"], "left")
    )
    rest = e.where(~override).withColumns({"is_billable": unknown, "in_candidates": unknown})
    named = rest.where("item_id is not null").unionByName(asked).join(items.select("item_id", "coded"), "item_id", "left")
    e = spread(named.unionByName(rest.where("item_id is null").withColumn("coded", unknown)), events, "encounter_id")
    before = W.partitionBy("encounter_id", "item_id").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    scoring = F.col("kind").isin(*SCORING)
    review = F.col("kind").isin(*REVIEWS)
    approval = F.col("kind") == APPROVAL
    e = e.withColumn("last_scoring", F.last(F.when(scoring, F.struct("kind", "code")), ignorenulls=True).over(before))
    assigned = F.col("last_scoring.code")
    broken = (
        F.when(approval | scoring, F.lit(None).cast("string"))
        .when(F.col("coded").isNull(), "unknown item")
        .when(~F.col("coded"), "not coded")
        .when(F.col("last_scoring").isNull(), "pending")
        .when((F.col("kind") == "approve") & assigned.isNull(), "nothing to approve")
        .when((F.col("kind") != "override") & F.col("code").isNotNull(), "code without override")
        .when((F.col("kind") == "override") & F.col("code").isNull(), "override without code")
        .when((F.col("kind") == "override") & F.col("is_billable").isNull(), "not billable")
    )
    e = e.withColumn("broken", broken)
    valid_review = review & F.col("broken").isNull()
    # 1 while the item is resolved: its latest scoring or valid review is a review.
    state = F.when(valid_review, F.lit(1)).when(scoring, F.lit(0))
    e = e.withColumn("state", state).withColumn(
        "was", F.coalesce(F.last("state", ignorenulls=True).over(before), F.lit(0))
    ).withColumn("delta", F.when(F.col("state").isNotNull(), F.col("state") - F.col("was")).otherwise(F.lit(0)))
    so_far = W.partitionBy("encounter_id").orderBy("seq").rowsBetween(W.unboundedPreceding, W.currentRow)
    needed = items.where("coded").groupBy("encounter_id").agg(F.count(F.lit(1)).alias("needed"))
    e = e.withColumn("resolved", F.sum("delta").over(so_far)).join(needed, "encounter_id", "left")
    complete = approval & (F.col("resolved") == F.coalesce("needed", F.lit(0)))
    closed_at = F.min(F.when(complete, F.col("seq"))).over(W.partitionBy("encounter_id"))
    e = e.withColumn("closed_at", closed_at)
    reason = (
        F.when(F.col("seq") > F.col("closed_at"), ALREADY)
        .when(F.col("broken").isNotNull(), F.col("broken"))
        .when(approval & ~complete, NEEDS_REVIEW)
    )
    final = (
        F.when(F.col("kind") == "approve", assigned).when(F.col("kind") == "override", F.col("code"))
    )
    return e.withColumn("reason", reason).select(
        "encounter_id", "item_id", "seq", "kind", "code", "actor", F.col("reason").isNull().alias("accepted"), "reason",
        F.when(review & F.col("reason").isNull(), final).alias("final_code"),
        F.when((F.col("kind") == "override") & F.col("reason").isNull(), F.coalesce("in_candidates", F.lit(False))).alias("in_candidates"),
        assigned.alias("assigned_code"), "resolved", F.coalesce("needed", F.lit(0)).alias("needed"),
    )


def review_state(replayed: DataFrame, items: DataFrame) -> DataFrame:
    """The state of every item after its accepted events."""
    taken = replayed.where("accepted and item_id is not null")
    last = taken.groupBy("item_id").agg(F.max(F.struct("seq", "kind", "code", "final_code")).alias("e"))
    scored = (
        taken.where(F.col("kind").isin(*SCORING)).groupBy("item_id").agg(F.max(F.struct("seq", "code")).alias("s"))
    )
    kind = F.col("e.kind")
    status = F.when(~F.col("coded"), "not_coded").when(F.col("e").isNull(), "pending")
    for action, name in RESOLVED.items():
        status = status.when(kind == action, name)
    return (
        items.select("encounter_id", "item_id", "coded")
        .join(last, "item_id", "left").join(scored, "item_id", "left")
        .select(
            "encounter_id", "item_id", status.otherwise(kind).alias("status"),
            F.col("s.code").alias("assigned_code"), F.col("e.final_code").alias("final_code"),
        )
    )


def approve_encounters(encounters: DataFrame, items: DataFrame) -> DataFrame:
    """V-08 on a snapshot: whether an encounter can be approved, why not, and how many items and codes decide it.

    The codes and the ids of unresolved items are rows of `approval_items`.
    """
    gate = items.groupBy("encounter_id").agg(
        F.count_if(F.col("status").isin(*UNRESOLVED)).alias("unresolved"), F.count_if(_billed()).alias("billed")
    )
    reason = (
        F.when(F.col("is_human_reviewed"), ALREADY)
        .when(F.coalesce("unresolved", F.lit(0)) > 0, NEEDS_REVIEW)
    )
    return (
        encounters.join(gate, "encounter_id", "left")
        .select(
            "encounter_id", F.coalesce("unresolved", F.lit(0)).alias("unresolved"),
            F.coalesce("billed", F.lit(0)).alias("billed"), reason.alias("reason"),
        )
        .withColumn("allowed", F.col("reason").isNull())
    )


def _reviewed() -> Column:
    return F.col("status").isin("approved", "overridden")


def _billed() -> Column:
    return _reviewed() & (F.coalesce("final_code", F.lit("")) != "")


def approval_items(encounters: DataFrame, items: DataFrame) -> DataFrame:
    """V-08: what an approval returns, a row an item: (encounter_id, allowed, sequence, item_id, status, final_code).

    For an encounter that can be approved, its items with a final code, which are its billing codes in order of
    `sequence`; for one held back by unresolved items, these, without a code. One that is approved already has no rows.
    """
    decided = approve_encounters(encounters, items).select("encounter_id", "reason", "allowed")
    unresolved = F.col("status").isin(*UNRESOLVED)
    wanted = (F.col("allowed") & _billed()) | ((F.col("reason") == NEEDS_REVIEW) & unresolved)
    return items.join(decided, "encounter_id").where(wanted).select(
        "encounter_id", "allowed", "sequence", "item_id", "status", F.when(F.col("allowed"), F.col("final_code")).alias("final_code")
    )


def unresolved_items(items: DataFrame) -> DataFrame:
    return items.where(F.col("status").isin(*UNRESOLVED)).select("encounter_id", "item_id", "status")


def _json(*columns: str | Column) -> Column:
    """A JSON object that names its empty fields too."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def _received(items: DataFrame, coded_types: tuple[str, ...]) -> DataFrame:
    """What arrived with an encounter: items by type, and the types that are coded."""
    by_type = items.groupBy("encounter_id", "item_type").agg(F.count(F.lit(1)).alias("n"))
    counts = F.map_from_entries(F.sort_array(F.collect_list(F.struct("item_type", "n"))))  # an entry a type
    coded = F.array(*[F.lit(t) for t in sorted(coded_types)])
    return by_type.groupBy("encounter_id").agg(_json(counts.alias("items"), coded.alias("coded_item_types")).alias("after"))


def _state_before(replayed: DataFrame) -> DataFrame:
    """Accepted item events with the item's status and final code before them."""
    earlier = W.partitionBy("encounter_id", "item_id").orderBy("seq")
    status = F.col("kind")
    for action, name in RESOLVED.items():
        status = F.when(F.col("kind") == action, name).otherwise(status)
    return (
        replayed.where("accepted and item_id is not null").withColumn("_status", status)
        .withColumn("was", F.coalesce(F.lag("_status").over(earlier), F.lit("pending")))
        .withColumn("had", F.lag("final_code").over(earlier))
        .drop("_status")
    )


def audit_events(
    items: DataFrame, outcomes: DataFrame, replayed: DataFrame | None, routed: DataFrame, coded_types: tuple[str, ...] = CODED_TYPES
) -> DataFrame:
    """V-09: one event per transition with its payload, as the union of what each stage did.

    items: encounter_id, item_id, item_type, coded, sequence. outcomes: encounter_id, item_id, kind (scored,
    scoring_failed, failed, no_candidates), payload. routed: encounter_id, status, review_queue. A review's `before` is
    the item's status, final code and assigned code; an approval's `after` the billing codes in order of
    `sequence`. Without `replayed` there are the events of a coding run alone.
    """
    none = F.lit(None).cast("string")
    no_item = F.lit(None).cast(items.schema["item_id"].dataType)
    zero = F.lit(0).cast("bigint")
    parts = [
        _received(items, coded_types).select("encounter_id", no_item.alias("item_id"), F.lit("encounter.received").alias("action"), none.alias("before"), "after", F.lit(0).alias("stage"), zero.alias("at")),
        outcomes.select("encounter_id", "item_id", F.concat(F.lit("item."), "kind").alias("action"), none.alias("before"), F.col("payload").alias("after"), F.lit(1).alias("stage"), zero.alias("at")),
        routed.select("encounter_id", no_item.alias("item_id"), F.lit("encounter.processed").alias("action"), none.alias("before"), _json("status", "review_queue").alias("after"), F.lit(2).alias("stage"), zero.alias("at")),
    ]
    if replayed is not None:
        override = F.col("kind") == "override"
        reviews = _state_before(replayed).where(~F.col("kind").isin(*SCORING))
        final = review_state(replayed, items).join(items.select("encounter_id", "item_id", "sequence"), ["encounter_id", "item_id"])
        approvals = replayed.where(F.col("accepted") & (F.col("kind") == APPROVAL)).select("encounter_id", F.col("seq").cast("bigint").alias("at"))
        coded = F.transform(F.sort_array(F.collect_list(F.when(_billed(), F.struct("sequence", "final_code")))), lambda x: x["final_code"])
        codes = final.join(approvals.select("encounter_id"), "encounter_id", "left_semi").groupBy("encounter_id").agg(coded.alias("codes"))
        no_codes = F.array().cast("array<string>")
        parts += [
            reviews.select(
                "encounter_id", "item_id", F.concat(F.lit("item."), "kind").alias("action"),
                _json(F.col("was").alias("status"), F.col("had").alias("final_code"), "assigned_code").alias("before"),
                F.when(override, _json("final_code", "in_candidates")).otherwise(_json("final_code")).alias("after"),
                F.lit(3).alias("stage"), F.col("seq").cast("bigint").alias("at"),
            ),
            approvals.join(codes, "encounter_id", "left").select(
                "encounter_id", no_item.alias("item_id"), F.lit("encounter.approved").alias("action"), none.alias("before"),
                _json(F.coalesce("codes", no_codes).alias("final_billing_codes")).alias("after"), F.lit(3).alias("stage"), "at",
            ),
        ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def audit_trail(events: DataFrame, encounters: DataFrame) -> DataFrame:
    """V-10: the events of the asked encounters in insertion order."""
    order = W.partitionBy("encounter_id").orderBy("stage", "at", "item_id", "action")
    asked = events.join(encounters.select("encounter_id"), "encounter_id", "left_semi")
    return asked.withColumn("position", F.row_number().over(order))


def retrieval_misses(replayed: DataFrame, by: list[str]) -> DataFrame:
    """V-11: accepted overrides whose code search had not offered, and their share."""
    overrides = replayed.where("accepted and kind = 'override'")
    missed = F.count_if(~F.col("in_candidates"))
    return overrides.groupBy(*by).agg(
        F.count(F.lit(1)).alias("overrides"), missed.alias("misses"), (missed / F.count(F.lit(1))).alias("miss_rate")
    )


def encounter_document(
    encounters: DataFrame, items: DataFrame, alternatives: DataFrame, billing: DataFrame
) -> DataFrame:
    """V-03: one nested record per encounter: input, items with classification and review, audit."""
    alt = alternatives.groupBy("item_id").agg(
        F.sort_array(F.collect_list(F.struct("place", "code", "probability"))).alias("top_alternatives")
    )
    coded = (
        items.join(alt, "item_id", "left")
        .groupBy("encounter_id")
        .agg(
            F.sort_array(
                F.collect_list(
                    F.struct("sequence", "item_id", "status", "assigned_code", "probability", "nota_probability", "flags", "final_code", "top_alternatives")
                )
            ).alias("coded_concepts")
        )
    )
    audit = F.struct("is_human_reviewed", F.col("billing_codes").alias("final_billing_codes"))
    return encounters.join(coded, "encounter_id", "left").join(billing, "encounter_id", "left").select(
        "encounter_id", "patient_id", "status", "review_queue", "coded_concepts", audit.alias("audit_trail"), "created_at"
    )


def encounter_record(
    encounters: DataFrame, items: DataFrame, decisions: DataFrame, alternatives: DataFrame, page_size: int = 1000
) -> DataFrame:
    """V-03: the whole record of every encounter, as pages of `page_size` items in order of `sequence`.

    encounters: encounter_id, patient_id, soap_note, department, status, review_queue, is_human_reviewed, reviewed_by,
    reviewed_at, created_at. items: encounter_id, item_id, item_type, sequence, text, details, status, error, assigned_code,
    assigned_display, probability, nota_probability, flags, final_code, final_display, review_action, reviewed_by,
    reviewed_at. decisions, the active one of an item: item_id, status, engine, model, latency_ms, candidates_scored.
    alternatives: item_id, place, code, display, probability, search_rank, matched_on.

    An item has a classification only where its active decision succeeded. Billing codes are those of the page's items,
    so no encounter is gathered into one row; one without items has a single page without any.
    """
    shown = alternatives.groupBy("item_id").agg(
        F.sort_array(F.collect_list(F.struct("place", "code", "display", "probability", "search_rank", "matched_on"))).alias("alternatives")
    )
    made = decisions.where("status = 'succeeded'").select("item_id", "engine", "model", "latency_ms", "candidates_scored")
    none = shown.schema["alternatives"].dataType
    classification = F.struct(
        "engine", "model", "assigned_code", F.col("assigned_display").alias("assigned_description"),
        F.round("probability", 6).alias("probability"),
        F.round(F.coalesce("nota_probability", F.lit(0.0)), 6).alias("none_of_the_above_probability"),
        F.coalesce("flags", F.array().cast("array<string>")).alias("flags"),
        F.coalesce("alternatives", F.array().cast(none)).alias("top_alternatives"),
        "candidates_scored", F.round("latency_ms", 1).alias("latency_ms"),
    )
    review = F.struct(
        F.col("review_action").alias("action"), "final_code", F.col("final_display").alias("final_description"), "reviewed_by", "reviewed_at"
    )
    item = F.struct(
        "sequence", "item_id", "item_type", "text", "details", "status", "error",
        F.when(F.col("engine").isNotNull(), classification).alias("ai_classification"), review.alias("review"),
    )
    open_code = F.when(_reviewed() | (F.col("status") == "scored"), F.coalesce("final_code", "assigned_code"))
    paged = (
        numbered(items, ["encounter_id"], "sequence", "_at")
        .join(made, "item_id", "left").join(shown, "item_id", "left")
        .groupBy("encounter_id", F.floor(F.col("_at") / page_size).cast("int").alias("page"))
        .agg(
            F.sort_array(F.collect_list(F.struct(F.col("_at").alias("at"), item.alias("item")))).alias("_items"),
            F.sort_array(F.collect_list(F.when(_billed(), F.struct("_at", F.col("final_code").alias("code"))))).alias("_final"),
            F.sort_array(F.collect_list(F.when(open_code != "", F.struct("_at", open_code.alias("code"))))).alias("_open"),
        )
    )
    codes = F.when(F.col("is_human_reviewed"), F.col("_final")).otherwise(F.col("_open"))
    trail = F.struct(
        "is_human_reviewed", "reviewed_by", "reviewed_at",
        F.coalesce(F.transform(codes, lambda c: c["code"]), F.array().cast("array<string>")).alias("final_billing_codes"),
    )
    return encounters.join(paged, "encounter_id", "left").select(
        "encounter_id", F.coalesce("page", F.lit(0)).alias("page"), "patient_id", "status", "review_queue",
        F.struct("soap_note", "department").alias("clinical_input"),
        F.transform("_items", lambda x: x["item"]).alias("coded_concepts"), trail.alias("audit_trail"), "created_at",
    )
