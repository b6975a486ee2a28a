"""Coding pipeline (C-01..C-17): intake, scoring, assignment and routing over whole tables.

An item is keyed by `item_id`; its candidates are bounded by the retrieval limit, so grouping
by item is grouping into small groups. `code IS NULL` in a score row is "none of the above".
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termweave.functions.codes import strip
from termweave.session import folded_join, salted_join

# Statuses, flags, thresholds and length limits.
LOW_CONFIDENCE = "LOW_CONFIDENCE"
NONE_OF_THE_ABOVE = "NONE_OF_THE_ABOVE"
NO_CANDIDATES = "NO_CANDIDATES"
SCORING_FAILED = "SCORING_FAILED"
LOW_CONFIDENCE_THRESHOLD = 0.75
NOTA_FLAG_THRESHOLD = 0.2
ITEM_LISTS = ("conditions", "observations", "service_requests", "medication_requests")
ITEM_TYPES = ("condition", "observation", "service_request", "medication_request")
CODED_TYPES = ("condition",)
ID_LENGTH, DEPARTMENT_LENGTH, NOTE_LENGTH, TEXT_LENGTH = 100, 200, 50_000, 500

_ITEM = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("details", T.StringType())]))
ENCOUNTER = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("encounter_id", "patient_id", "department", "soap_note")]
    + [T.StructField(c, _ITEM) for c in ITEM_LISTS]
)
_ITEM_KEYS = T.StructType([T.StructField(c, T.ArrayType(T.MapType(T.StringType(), T.StringType()))) for c in ITEM_LISTS])


def validate_encounters(lines: DataFrame, value: str = "value") -> DataFrame:
    """C-01: parsed encounters with `violations`, an array of broken rules (empty when valid).

    `lines` holds one JSON document per row; its other columns are kept.
    """
    allowed = F.array(*[F.lit(f.name) for f in ENCOUNTER.fields])
    parsed = lines.withColumn("e", F.from_json(value, ENCOUNTER)).withColumn("keys", F.from_json(value, _ITEM_KEYS))
    e = F.col("e")

    def items(name: str) -> Column:
        return F.coalesce(e[name], F.array().cast(_ITEM))

    def length_of(name: str, most: int) -> Column:
        n = F.length(e[name])
        return F.when(e[name].isNull() | (n < 1) | (n > most), F.lit(f"{name} length"))

    text_bad = F.lit(False)
    unknown_item = F.lit(False)
    n_items = F.lit(0)
    for name in ITEM_LISTS:
        text_bad = text_bad | F.exists(
            items(name), lambda x: x["text"].isNull() | (F.length(x["text"]) < 1) | (F.length(x["text"]) > TEXT_LENGTH)
        )
        item_maps = F.coalesce(F.col("keys")[name], F.array().cast("array<map<string,string>>"))
        unknown_item = unknown_item | F.exists(
            item_maps, lambda m: F.size(F.array_except(F.map_keys(m), F.array(F.lit("text"), F.lit("details")))) > 0
        )
        n_items = n_items + F.size(items(name))
    unknown = F.array_except(F.coalesce(F.json_object_keys(F.col(value)), F.array().cast("array<string>")), allowed)
    rules = F.array_compact(
        F.array(
            F.when(F.json_object_keys(F.col(value)).isNull(), F.lit("not a JSON object")),
            length_of("encounter_id", ID_LENGTH),
            length_of("patient_id", ID_LENGTH),
            F.when(F.length(e["department"]) > DEPARTMENT_LENGTH, F.lit("department length")),
            length_of("soap_note", NOTE_LENGTH),
            F.when(text_bad, F.lit("item text length")),
            F.when(n_items == 0, F.lit("no items")),
            F.when(F.size(unknown) > 0, F.concat(F.lit("unknown field "), F.array_join(F.sort_array(unknown), ","))),
            F.when(unknown_item, F.lit("unknown item field")),
        )
    )
    return parsed.withColumn("violations", rules).drop("keys")


def accepted(validated: DataFrame) -> DataFrame:
    keep = [c for c in validated.columns if c not in ("e", "violations", "value")]
    return validated.where(F.size("violations") == 0).select(*keep, "e.*")


def quarantined(validated: DataFrame) -> DataFrame:
    return validated.where(F.size("violations") > 0).withColumn("rule", F.explode("violations")).drop("e", "violations")


def flatten_items(encounters: DataFrame, coded_types: tuple[str, ...] = CODED_TYPES) -> DataFrame:
    """C-02: one row per item; conditions first, then observations, service and medication requests."""

    def typed(name: str, kind: str) -> Column:
        return F.transform(
            F.coalesce(F.col(name), F.array().cast(_ITEM)),
            lambda x: F.struct(F.lit(kind).alias("item_type"), x["text"].alias("text"), x["details"].alias("details")),
        )

    lists = [typed(name, kind) for name, kind in zip(ITEM_LISTS, ITEM_TYPES)]
    return (
        encounters.select("encounter_id", F.posexplode(F.concat(*lists)).alias("at", "item"))
        .select("encounter_id", (F.col("at") + 1).alias("sequence"), "item.*")
        .withColumn("status", F.when(F.col("item_type").isin(*coded_types), "pending").otherwise("not_coded"))
        .withColumn("flags", F.array().cast("array<string>"))
    )


def reject_duplicates(incoming: DataFrame, stored: DataFrame, order: str) -> DataFrame:
    """C-03: `incoming` with `rejected`: "already stored", "repeated" or NULL when taken.

    `order` identifies a row among the arrivals; the first one of an id is taken.
    """
    known = stored.select("encounter_id", F.lit(True).alias("known")).distinct()
    first = incoming.groupBy("encounter_id").agg(F.min(order).alias("first")).join(known, "encounter_id", "left")
    reason = F.when(F.col("known"), "already stored").when(F.col(order) != F.col("first"), "repeated")
    return (
        salted_join(incoming, first, ["encounter_id"], [order])
        .withColumn("rejected", reason).drop("first", "known")
    )


def mark_no_candidates(items: DataFrame, candidates: DataFrame) -> DataFrame:
    """C-05: items without a single hit."""
    return items.join(candidates.select("item_id").distinct(), "item_id", "left_anti").select(
        *[c for c in items.columns if c not in ("status", "flags")],
        F.lit("no_candidates").alias("status"), F.array(F.lit(NO_CANDIDATES)).alias("flags"),
    )


def score_search_rank(candidates: DataFrame, temperature: float = 1.0) -> DataFrame:
    """C-06: stand-in scorer, exp(-(rank - 1) / T) normalised per item. Not calibrated."""
    weight = F.exp(-(F.col("search_rank") - 1) / F.lit(float(temperature)))
    total = F.sum("w").over(W.partitionBy("item_id"))
    return candidates.withColumn("w", weight).select("item_id", "code", (F.col("w") / total).alias("probability"))


SEARCH_RANK = "search-rank"


def decide_by_rank(items: DataFrame, candidates: DataFrame, temperature: float = 1.0) -> DataFrame:
    """C-06 as decisions of the built-in engine, with the columns of `score_with`; columns only, no Python."""
    offered = candidates.join(items.select("item_id"), "item_id", "left_semi")
    scored = score_search_rank(offered, temperature).groupBy("item_id").agg(F.collect_list(F.struct("code", "probability")).alias("probabilities"))
    return scored.select(
        "item_id", F.lit(SEARCH_RANK).alias("engine"), F.lit(f"exponential decay over search ranks, T = {temperature:g}").alias("model"),
        F.lit("succeeded").alias("status"), F.lit(None).cast("string").alias("error"), F.lit(0.0).alias("nota_probability"),
        F.lit(None).cast("double").alias("cost"), F.lit(0.0).alias("latency_ms"), "probabilities",
    )


Scorer = Callable[[str, str, list[dict]], dict]
OUTCOME = (
    "engine string, model string, status string, error string, nota_probability double, cost double, latency_ms double, "
    "probabilities array<struct<code:string,probability:double>>"
)


def score_with(
    items: DataFrame, candidates: DataFrame, engines: Mapping[str, Callable[[], Scorer]], name: str
) -> DataFrame:
    """C-07 and C-09: run a scorer by name over every item that has candidates.

    `items`: item_id, text, note. A scorer takes (note, text, candidates in search order) and
    returns model, probabilities {code: p}, nota_probability and cost. An item it fails on
    comes back as a failed decision with the error; the others are not affected.
    """
    if name not in engines:
        raise ValueError(f"unknown decision engine {name!r}; available: {sorted(engines)}")
    build = engines[name]
    offered = candidates.groupBy("item_id").agg(
        F.sort_array(F.collect_list(F.struct("search_rank", "code", "display"))).alias("offered")
    )
    joined = items.select("item_id", "text", "note").join(offered, "item_id")
    key = joined.schema["item_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = build()
        for frame in frames:
            rows = []
            for row in frame.itertuples(index=False):
                options = [{"search_rank": o["search_rank"], "code": o["code"], "display": o["display"]} for o in row.offered]
                begun = time.perf_counter()
                try:
                    r = scorer(row.note, row.text, options)
                    outcome = (r.get("model"), "succeeded", None, float(r.get("nota_probability", 0.0)), r.get("cost"))
                    scores = [{"code": c, "probability": float(p)} for c, p in r["probabilities"].items()]
                except Exception as problem:  # noqa: BLE001 - a failing item is a result, not a job failure
                    outcome = (None, "failed", f"{name}: {problem}"[:500], None, None)
                    scores = []
                model, status, error, nota, cost = outcome
                spent = (time.perf_counter() - begun) * 1000
                rows.append((row.item_id, name, model, status, error, nota, cost, spent, scores))
            yield pd.DataFrame(
                rows,
                columns=["item_id", "engine", "model", "status", "error", "nota_probability", "cost", "latency_ms", "probabilities"],
            )

    return joined.mapInPandas(run, f"item_id {key}, {OUTCOME}")


def isolate_failures(items: DataFrame, decisions: DataFrame, search_failures: DataFrame | None = None) -> DataFrame:
    """C-09: items whose scoring or search failed: status, flag, truncated error, no assignment.

    A failed scorer run is a decision (event item.scoring_failed); a failed search is not (item.failed).
    """
    failed = decisions.where("status = 'failed'").select(
        "item_id", F.substring("error", 1, 500).alias("error"), F.lit("item.scoring_failed").alias("event")
    )
    if search_failures is not None:
        failed = failed.unionByName(
            search_failures.select("item_id", F.substring("error", 1, 500).alias("error"), F.lit("item.failed").alias("event"))
        )
    return items.drop("status", "flags", "error").join(failed, "item_id").withColumns(
        {"status": F.lit("failed"), "flags": F.array(F.lit(SCORING_FAILED)), "assigned_code": F.lit(None).cast("string")}
    )


def closed_set_filter(scores: DataFrame, candidates: DataFrame) -> DataFrame:
    """C-08: only probabilities of codes that were offered (and "none of the above")."""
    return folded_join(scores.where("code is not null"), candidates.select("item_id", "code"), ["item_id", "code"], "left_semi")


def unknown_options(scores: DataFrame, candidates: DataFrame) -> DataFrame:
    """C-08: codes a scorer returned without having been offered them."""
    return (
        scores.where("code is not null")
        .join(candidates.select("item_id", "code"), ["item_id", "code"], "left_anti")
        .select("item_id", "code")
    )


def rank_scores(candidates: DataFrame, scores: DataFrame, nota: DataFrame) -> DataFrame:
    """C-10: every candidate (missing ones at 0) and a NOTA row, most probable first.

    Equal probabilities keep search order, NOTA last. `nota`: item_id, nota_probability.
    Tables that are placed by item alike stay where they are.
    """
    offered = candidates.select("item_id", "code", "search_rank")
    real = folded_join(offered, scores.select("item_id", "code", "probability"), ["item_id", "code"]).select(
        "item_id", "code", "search_rank", F.coalesce("probability", F.lit(0.0)).alias("probability")
    )
    none = nota.select(
        "item_id", F.lit(None).cast("string").alias("code"), F.lit(None).cast("int").alias("search_rank"),
        F.coalesce("nota_probability", F.lit(0.0)).alias("probability"),
    )
    order = W.partitionBy("item_id").orderBy(F.desc("probability"), F.col("code").isNull(), "search_rank")
    return real.unionByName(none).withColumn("rank", F.row_number().over(order))


def assign(
    ranked: DataFrame, low: float = LOW_CONFIDENCE_THRESHOLD, nota: float = NOTA_FLAG_THRESHOLD
) -> DataFrame:
    """C-11: the best real candidate of each item, even when NOTA ranks first, and the flags."""
    real = F.col("code").isNotNull()
    per_item = ranked.groupBy("item_id").agg(
        F.min(F.when(real, F.struct("rank", "code", "probability"))).alias("best"),
        F.coalesce(F.max(F.when(~real, F.col("probability"))), F.lit(0.0)).alias("nota_probability"),
        F.max((~real & (F.col("rank") == 1) & (F.col("probability") > 0)).cast("int")).alias("nota_first"),
    )
    p = F.col("best.probability")
    flags = F.when(F.col("best").isNull(), F.array(F.lit(NO_CANDIDATES))).otherwise(
        F.array_compact(
            F.array(
                F.when(p < low, F.lit(LOW_CONFIDENCE)),
                F.when((F.col("nota_probability") >= nota) | (F.col("nota_first") == 1), F.lit(NONE_OF_THE_ABOVE)),
            )
        )
    )
    return per_item.select(
        "item_id", F.col("best.code").alias("assigned_code"), p.alias("probability"), "nota_probability", flags.alias("flags")
    )


def review_queue(items: DataFrame) -> DataFrame:
    """C-12 and C-13: queue and status per encounter from its items (status, flags)."""
    coded = F.col("status") != "not_coded"
    attention = coded & ((F.size("flags") > 0) | F.col("status").isin("no_candidates", "failed"))
    return items.groupBy("encounter_id").agg(
        F.when(F.bool_or(attention), "close_review").otherwise("standard").alias("review_queue"),
        F.when(
            (F.count_if(coded) > 0) & (F.count_if(coded) == F.count_if(F.col("status") == "failed")), "failed"
        ).otherwise("ready_for_review").alias("status"),
    )


def active_decision(decisions: DataFrame) -> DataFrame:
    """C-14: per item the newest decision; earlier ones stay, inactive."""
    rest = [c for c in decisions.columns if c != "item_id"]
    newest = decisions.groupBy("item_id").agg(F.max_by(F.struct(*rest), "decision_id").alias("d"), F.count(F.lit(1)).alias("runs"))
    return newest.select("item_id", "d.*", "runs")


def item_state(decisions: DataFrame, reviews: DataFrame) -> DataFrame:
    """C-14: the active decision with the newest review made after it; earlier reviews are void.

    `decisions` and `reviews` share the clock `at`.
    """
    active = active_decision(decisions).withColumnRenamed("at", "decided_at")
    valid = reviews.join(active.select("item_id", "decided_at"), "item_id").where(F.col("at") > F.col("decided_at"))
    last = valid.groupBy("item_id").agg(F.max(F.struct("at", "action", "code")).alias("r"))
    return active.join(last, "item_id", "left").select(
        "item_id", "engine", "status", "runs", F.col("r.action").alias("review_action"), F.col("r.code").alias("review_code")
    )


def rescore(
    items: DataFrame, candidates: DataFrame, approved: DataFrame, engines: Mapping[str, Callable[[], Scorer]], name: str
) -> DataFrame:
    """C-15: another scorer over stored candidates; approved encounters and uncoded items are skipped."""
    open_items = items.where("status <> 'not_coded'").join(approved.select("encounter_id"), "encounter_id", "left_anti")
    return score_with(open_items, candidates, engines, name)


def decision_cost(decisions: DataFrame, prices: DataFrame) -> DataFrame:
    """C-16: the reported cost, 0 for free models, tokens at the list price, or NULL."""
    cost = (
        F.when(F.col("reported_cost").isNotNull(), F.col("reported_cost"))
        .when(F.col("model").endswith("-free"), F.lit(0.0))
        .otherwise(F.col("input_tokens") * F.col("price_per_million") / 1_000_000)
    )
    return decisions.join(prices, "engine", "left").withColumn("cost", cost).drop("price_per_million")


def note_mentions(notes: DataFrame) -> DataFrame:
    """C-17: (encounter_id, mention, start): case-insensitive verbatim occurrences of item texts.

    `notes`: encounter_id, note, texts array<string>. Leftmost matches that do not overlap, the
    longest text first, found by one alternation per encounter; `start` is 0-based.
    """
    terms = F.array_distinct(F.filter(F.transform("texts", strip), lambda t: F.length(t) >= 3))
    longest = F.array_sort(
        terms, lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).otherwise(0)
    )
    escaped = F.transform(longest, lambda t: F.regexp_replace(t, r"([.*+?^${}()|\[\]\\])", r"\\$1"))
    pattern = F.concat(F.lit("(?iu)"), F.array_join(escaped, "|"))
    found = notes.withColumn("terms", terms).where(F.size("terms") > 0).withColumn("pattern", pattern)
    pieces = (
        found.withColumn("hits", F.expr("regexp_extract_all(note, pattern, 0)"))
        .withColumn("gaps", F.expr("split(note, pattern)"))
        .where(F.size("hits") > 0)
    )
    lengths = F.zip_with(
        F.slice("gaps", F.lit(1), F.size("hits")), "hits",
        lambda g, h: F.struct(F.length(g).alias("gap"), h.alias("hit")),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<mention:string,start:int>>").alias("out"))
    folded = F.aggregate(
        lengths, start,
        lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + F.length(x["hit"])).alias("at"),
            F.concat(acc["out"], F.array(F.struct(x["hit"].alias("mention"), (acc["at"] + x["gap"]).alias("start")))).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return pieces.select("encounter_id", F.explode(folded).alias("m")).select("encounter_id", "m.mention", "m.start")
