"""Further quality measures of the proposal (P-01..P-08): calibration, thresholds, code sets, BM25."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from termweave.functions.codes import undotted
from termweave.operators.lexical import DOC, LexicalIndex, salted
from termweave.session import materialise, spread


def calibration_bins(scored: DataFrame, bins: int = 10) -> DataFrame:
    """P-01: per probability bin the count, mean probability and observed rate.

    scored: probability in 0..1, correct 0/1.
    """
    bin_ = F.least(F.floor(F.col("probability") * bins), F.lit(bins - 1)).cast("int")
    return scored.groupBy(bin_.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("probability").alias("mean_probability"), F.avg("correct").alias("observed")
    )


def calibration_error(scored: DataFrame, bins: int = 10) -> DataFrame:
    """P-01: expected calibration error and Brier score."""
    table = calibration_bins(scored, bins)
    ece = table.agg((F.sum(F.col("n") * F.abs(F.col("mean_probability") - F.col("observed"))) / F.sum("n")).alias("ece"))
    brier = scored.agg(F.avg(F.pow(F.col("probability") - F.col("correct"), 2)).alias("brier"))
    return ece.withColumn("_one", F.lit(1)).join(brier.withColumn("_one", F.lit(1)), "_one").drop("_one")


def threshold_curve(scored: DataFrame, thresholds: list[float]) -> DataFrame:
    """P-02: per threshold the share sent to close review and the error left in the standard queue."""
    at = F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))
    close = F.col("probability") < F.col("threshold")
    kept = F.count_if(~close)
    return scored.withColumn("threshold", at).groupBy("threshold").agg(
        (F.count_if(close) / F.count(F.lit(1))).alias("close_share"),
        F.when(kept > 0, F.count_if(~close & (F.col("correct") == 0)) / kept).alias("standard_error"),
    )


def topk_given_retrieved(ranked: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """P-03: of the items whose gold code was offered, the share ranked in the top k.

    ranked: item_id, code, rank (real candidates); gold: item_id, code.
    """
    offered = ranked.join(gold, ["item_id", "code"])
    return offered.agg(
        F.count(F.lit(1)).alias("retrieved"), *[(F.count_if(F.col("rank") <= k) / F.count(F.lit(1))).alias(f"top_{k}") for k in ks]
    )


def nota_quality(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """P-03: precision and recall of "none of the above" against the gold code's absence."""
    said = ranked.groupBy("item_id").agg(F.max((F.col("code").isNull() & (F.col("rank") == 1)).cast("int")).alias("said"))
    present = ranked.where("code is not null").join(gold, ["item_id", "code"]).select("item_id", F.lit(1).alias("present")).distinct()
    both = said.join(gold.select("item_id").distinct(), "item_id").join(present, "item_id", "left")
    absent = F.col("present").isNull()
    true_positive = F.count_if((F.col("said") == 1) & absent)
    said_n, absent_n = F.count_if(F.col("said") == 1), F.count_if(absent)
    return both.agg(
        F.when(said_n > 0, true_positive / said_n).alias("precision"), F.when(absent_n > 0, true_positive / absent_n).alias("recall")
    )


def encounter_f1(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """P-04: micro and macro F1 over code sets, and the share of exactly matching encounters."""
    p = predicted.select("encounter_id", "code", F.lit(1).alias("p")).distinct()
    g = gold.select("encounter_id", "code", F.lit(1).alias("g")).distinct()
    both = p.join(g, ["encounter_id", "code"], "full_outer")
    per = both.groupBy("encounter_id").agg(
        F.count_if(F.col("p").isNotNull() & F.col("g").isNotNull()).alias("tp"), F.count("p").alias("np"), F.count("g").alias("ng")
    )
    return per.agg(
        (2 * F.sum("tp") / (F.sum("np") + F.sum("ng"))).alias("micro_f1"),
        F.avg(2 * F.col("tp") / (F.col("np") + F.col("ng"))).alias("macro_f1"),
        (F.count_if((F.col("tp") == F.col("np")) & (F.col("tp") == F.col("ng"))) / F.count(F.lit(1))).alias("exact"),
    )


def accuracy_by_level(pairs: DataFrame, levels: tuple[int, ...] = (1, 3, 4, 5, 6, 7)) -> DataFrame:
    """P-05: agreement of assigned and gold code on their first n characters. pairs: assigned, gold."""
    n = F.explode(F.array(*[F.lit(x) for x in levels]))
    both = pairs.select(undotted(F.col("assigned")).alias("a"), undotted(F.col("gold")).alias("g"), n.alias("level"))
    same = F.substring(F.col("a"), F.lit(1), F.col("level")) == F.substring(F.col("g"), F.lit(1), F.col("level"))
    return both.where(F.length("g") >= F.col("level")).groupBy("level").agg(
        F.count(F.lit(1)).alias("n"), (F.count_if(same) / F.count(F.lit(1))).alias("accuracy")
    )


def assemble_codes(findings: DataFrame) -> DataFrame:
    """P-06: negated findings dropped, equal codes merged, ordered by first mention per encounter.

    findings: encounter_id, sequence, code, negated.
    """
    merged = findings.where(~F.col("negated") & F.col("code").isNotNull()).groupBy("encounter_id", "code").agg(
        F.min("sequence").alias("first"), F.count(F.lit(1)).alias("mentions")
    )
    return merged.withColumn("position", F.row_number().over(W.partitionBy("encounter_id").orderBy("first", "code")))


def temperature_scale(scores: DataFrame, gold: DataFrame, temperatures: list[float]) -> DataFrame:
    """P-07: log loss of the gold code per temperature; the least one is marked.

    scores: item_id, code, probability > 0 (real candidates); gold: item_id, code.
    """
    grid = scores.withColumn("t", F.explode(F.array(*[F.lit(float(t)) for t in temperatures])))
    powered = grid.withColumn("w", F.pow("probability", 1 / F.col("t")))
    hit = gold.select("item_id", "code", F.lit(True).alias("hit"))
    per_item = powered.join(hit, ["item_id", "code"], "left").groupBy("item_id", "t").agg(
        (F.sum(F.when(F.col("hit"), F.col("w"))) / F.sum("w")).alias("p")
    )
    loss = per_item.where("p is not null").groupBy("t").agg(F.avg(-F.log("p")).alias("log_loss"), F.count(F.lit(1)).alias("n"))
    least = loss.agg(F.min_by("t", F.struct("log_loss", "t")).alias("best")).withColumn("_one", F.lit(1))
    return (
        loss.withColumn("_one", F.lit(1)).join(least, "_one").withColumn("is_best", F.col("t") == F.col("best"))
        .select(F.col("t").alias("temperature"), "log_loss", "n", "is_best")
    )


def bm25_rank(queries: DataFrame, index: LexicalIndex, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """P-08: BM25 score of every (query text, document) pair that shares a token.

    Documents are placed once by their key with their words; words are counted, weighed and summed up where they stand, as long
    as the queries' words are few enough to be sent there. Else hot words are spread over their salts.
    """
    documents = index.documents.select(*DOC, F.size("entries").alias("size"), F.col("entries.token").alias("words"))
    stats = documents.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.avg("size").alias("mean"))
    entries = spread(documents, index.documents, *DOC).select(*DOC, "size", F.explode("words").alias("token"))
    tf = entries.groupBy(*DOC, "token").agg(F.count(F.lit(1)).alias("tf"), F.first("size").alias("size"))
    words = index.frequencies.where("kind = 'word'")
    weighed = salted(tf, words, ["source", "token"])
    keys = (
        queries.select("text_id", F.explode("tokens").alias("token"))
        .join(words.drop("kind"), "token").join(F.broadcast(stats), "source")  # one row per source
        .withColumn("idf", F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        .select("text_id", "source", "token", "salt", "idf", "mean")
    )
    pairs = weighed.join(materialise(keys, "bm25-keys"), ["source", "token", "salt"])
    norm = 1 - b + b * F.col("size") / F.col("mean")
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * norm)
    return pairs.groupBy("text_id", *DOC).agg(F.sum(part).alias("score"))
