"""Spelling variants: words one edit apart, found by asymmetric q-chunks, and the form each stands for.

A single edit lies inside one part of a word and leaves the disjoint chunks around this part whole. For every part of a word of
m code points its two chunks are one key. The other word, of the same length or one longer, offers its positional grams for the
same places, those behind the part shifted by the difference in length, so by one at most. Equal keys meet in a join and whole
words are verified. Cutting a word into two halves only is the plain form of this (`part` at half a word); then all words of one
beginning would meet. Parts of two code points keep the words under a key to those that differ in these two, a number the
alphabet bounds; words above 64 code points have 32 parts, so their keys stay few.

A substitution shows in one part only. An insertion into a run of equal letters may show in several; the first counts, so that
pairs need no second exchange.

Defined results. Null and empty texts have no words; a null id reads as the empty string in the digest. Repeated rows count as
often as they occur. Of near words with equal counts the smallest in code-point order is the form. An empty table gives no rows.
Only the named columns are read, so clashing names do no harm.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave.llm.common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "[A-Za-zÀ-ÿ]+"
PART, MOST_PARTS = 2, 32


@dataclass(frozen=True)
class Spelling:
    """Words have `least_length` code points and occur `least_count` times; a form occurs `ratio` times as often."""

    least_length: int = 6
    least_count: int = 5
    ratio: int = 5
    part: int = PART


def runs(text: Column) -> Column:
    """The maximal runs of letters of a text, A-Z in lower case."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(RUN), F.lit(0))


def worn(row_id: Column, run: Column, period: int) -> Column:
    """The run, without one code point where the digest of id and run is a multiple of `period`."""
    digest = F.crc32(F.concat(F.coalesce(row_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (digest % F.length(run)).cast("int")
    return F.when(digest % period == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def word_counts(words: DataFrame, column: str, options: Spelling) -> DataFrame:
    """(word, n) of the words that are long and frequent enough; counted before they are shuffled."""
    long = words.select(F.col(column).alias("word")).filter(F.length("word") >= options.least_length)
    return long.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= options.least_count)


def _keys(counts: DataFrame, extra: int, part: int) -> DataFrame:
    """One row per part of a word of length - `extra` code points: its number, the start, and the chunks around it as a key."""
    base = counts.withColumn("m", (F.length("word") - extra).cast("int"))
    sized = base.withColumn("w", F.greatest(F.lit(part), F.ceil(F.col("m") / MOST_PARTS).cast("int")))
    placed = sized.withColumn("i", F.explode(F.sequence(F.lit(0), F.floor((F.col("m") - 1) / F.col("w")).cast("int"))))
    start = F.col("i") * F.col("w")
    end = F.least(start + F.col("w"), F.col("m"))
    before, after = F.substring("word", F.lit(1), start), F.substring("word", end + extra + 1, F.length("word"))
    return placed.select("word", "n", F.lit(extra).alias("extra"), start.alias("start"), F.xxhash64("m", "i", before, after).alias("key"))


def near_pairs(counts: DataFrame, options: Spelling | None = None) -> DataFrame:
    """(a, n_a, b, n_b): every unordered pair of words one edit apart, once; b is not shorter."""
    part = (options or Spelling()).part
    chunks = _keys(counts, 0, part)
    grams = chunks.unionByName(_keys(counts, 1, part))
    left = chunks.select("key", F.col("word").alias("a"), F.col("n").alias("n_a"), "start")
    right = grams.select("key", F.col("word").alias("b"), F.col("n").alias("n_b"), "extra")
    first = (F.col("start") == 0) | (F.expr("substring(a, start + 1)") != F.expr("substring(b, start + 2)"))
    wanted = F.when(F.col("extra") == 0, F.col("a") < F.col("b")).otherwise((F.length("b") == F.length("a") + 1) & first)
    met = left.join(right, "key").filter(wanted & (F.levenshtein("a", "b", 1) == 1))
    return met.select("a", "n_a", "b", "n_b")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words with a form. A form occurs more often than its word, so chains end; lengths double each round."""
    now = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = written(now.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        if after.filter("moved").isEmpty():
            return after.drop("moved")
        now = after.drop("moved")


def variants(counts: DataFrame, options: Spelling | None = None) -> DataFrame:
    """word, form, root, n, n_near, form_n of every counted word."""
    options = options or Spelling()
    counts = written(counts, "spelling-words")
    pairs = near_pairs(counts, options)
    both = pairs.select(
        F.explode(F.array(
            F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("m")),
            F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("m")),
        )).alias("p")
    ).select("p.*")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "other")).alias("best"))
    enough = -F.col("best.less") >= options.ratio * F.col("n")
    judged = written(
        counts.join(best, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(enough, F.col("best.other")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n"),
        ),
        "spelling-forms",
    )
    roots = _roots(judged.filter("form is not null"))
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
