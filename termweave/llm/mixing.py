"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source has a token budget. Whole epochs of a source come first; what is left of its budget is filled by a weighted
sample without replacement: each document draws an exponential key whose rate is its quality weight, keys are sorted within
the source, and sizes are summed up along them until the budget is reached. The last document of the sample counts with its
first tokens only, so a source meets its budget to the token.

No source is sorted in one task. A key falls into a cell by its logarithm (1,024 cells to a doubling), so a cell holds no more
than about 1/2,000 of a source whatever its weights are; sizes are summed by cell, the cells of a source (some ten thousand at
most) are summed up along the key, and rows are sorted within their cell only.

Defined results. A null source is a source of its own, the last one. A null text has size 0 and takes nothing. A null, negative
or zero weight counts as the least weight. Rows that repeat an id with the same size are alike and take their turns in any
order. An empty table gives no rows. Columns of the input keep their names; the result is one struct under a name not in use.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from termweave.llm.common import BLANK_CLASS, free_name, written

CELLS_PER_DOUBLING = 1024
#: 52 bits of a digest and a half, over 2^52: strictly between 0 and 1 and exact as a double.
_BITS, _DIGITS = 52, 13
LEAST_WEIGHT = 0.05
#: Characters that prose seldom has; their share lowers the quality weight.
UNUSUAL = "0123456789#*$%&|<>{}[]()_=+~^@/\\"


@dataclass(frozen=True)
class Mix:
    """`shares`: weights of the sources in code-point order, repeating. `volume`: tokens of the mix over tokens of the input.
    `most`: epochs of a source at most. `seed`: names the draw."""

    shares: tuple[float, ...] = (5, 2, 1)
    volume: float = 1.5
    most: int = 2
    seed: str = "mix"


def word_count(text: Column) -> Column:
    """Runs without blanks in a text; 0 for null."""
    parts = F.split(text, f"{BLANK_CLASS}+")
    edges = F.when(F.element_at(parts, 1) == "", 1).otherwise(0) + F.when(F.element_at(parts, -1) == "", 1).otherwise(0)
    return F.when(F.length(F.coalesce(text, F.lit(""))) == 0, F.lit(0)).otherwise(F.greatest(F.size(parts) - edges, F.lit(0))).cast("bigint")


def quality_weight(text: Column) -> Column:
    """Share of the characters that are not unusual in prose, LEAST_WEIGHT at least."""
    body = F.coalesce(text, F.lit(""))
    share = F.length(F.translate(body, UNUSUAL, "")) / F.greatest(F.length(body), F.lit(1))
    return F.greatest(share, F.lit(LEAST_WEIGHT))


def exponential_key(row_id: Column, weight: Column, seed: str) -> Column:
    """-ln(u) / weight with u from a digest of the id: the smallest keys are a weighted sample without replacement."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(row_id.cast("string"), F.lit("")))
    drawn = F.conv(F.substring(F.md5(name.cast("binary")), 1, _DIGITS), 16, 10).cast("bigint")
    uniform = (drawn + F.lit(0.5)) / F.lit(float(2**_BITS))
    return -F.log(uniform) / F.greatest(F.coalesce(weight.cast("double"), F.lit(0.0)), F.lit(LEAST_WEIGHT))


def _ranked(sources: DataFrame) -> DataFrame:
    """`place`: 0-based position of each source in code-point order, nulls last, over ranges of sources."""
    parts = written(sources.repartitionByRange("unnamed", "host").withColumn("part", F.spark_partition_id()), "mix-sources")
    ahead = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row per range
    first = parts.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("first"))
    inside = F.row_number().over(W.partitionBy("part").orderBy("unnamed", "host")) - 1
    return parts.withColumn("inside", inside).join(first, "part").select("host", "source_size", (F.col("first") + F.col("inside")).alias("place"))


def targets(sources: DataFrame, mix: Mix) -> DataFrame:
    """(host, source_size, target) of each source: shares of the volume, none above `most` times its size.

    The level is the volume per unit of weight. Sources that it would take above their limit get the limit, and the rest of
    the volume is shared anew among the others, until none is above. Only sums come to the driver.
    """
    shares = F.array(*[F.lit(float(s)) for s in mix.shares])
    ranked = written(
        _ranked(sources).withColumn("weight", F.element_at(shares, (F.pmod("place", F.lit(len(mix.shares))) + 1).cast("int"))), "mix-weights"
    )
    limit = F.col("source_size") * float(mix.most)
    total, weight = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    volume, level, full = mix.volume * total, 0.0, -1
    held, left = 0, weight
    while left > 0:
        level = (volume - mix.most * held) / left
        above = F.col("weight") * level > limit
        n, held, left = ranked.agg(
            F.count(F.when(above, 1)), F.coalesce(F.sum(F.when(above, F.col("source_size"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0)),
        ).first()
        if n == full:
            break
        full = n
    target = F.least(limit, F.col("weight") * level) if left > 0 else limit
    return ranked.select("host", "source_size", target.cast("double").alias("target"))


def mixed(
    docs: DataFrame, size: Column, weight: Column, *, row_id: str = "doc_id", source: str = "source",
    keep: Sequence[str] | None = None, mix: Mix | None = None,
) -> tuple[DataFrame, str]:
    """The `keep` columns of every row and a struct (size, source_size, target, taken), with the struct's name.

    `taken` counts the tokens the mix takes of the row, repeats included: whole epochs times its size, and what the sample
    takes of it beyond them.
    """
    mix = mix or Mix()
    kept = docs.select(*(docs.columns if keep is None else keep))
    into = free_name(kept, "mix")
    named = F.col(source).cast("string")
    measured = written(
        docs.select(
            F.struct(*kept.columns).alias("row"), F.coalesce(F.concat(F.lit("s"), named), F.lit("n")).alias("host"),
            F.coalesce(size.cast("bigint"), F.lit(0)).alias("size"), F.col(row_id).cast("string").alias("id"),
            exponential_key(F.col(row_id), weight, mix.seed).alias("key"),
        ).withColumn("cell", F.floor(F.log2("key") * CELLS_PER_DOUBLING)),
        "mix-sizes",
    )
    cells = written(measured.groupBy("host", "cell").agg(F.sum("size").alias("held")), "mix-cells")
    sources = cells.groupBy("host").agg(F.sum("held").alias("source_size")).withColumn("unnamed", (F.col("host") == "n").cast("int"))
    before = W.partitionBy("host").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = (
        cells.withColumn("ahead", F.coalesce(F.sum("held").over(before), F.lit(0)))
        .join(targets(sources, mix), "host").withColumn("epochs", epochs)
        .withColumn("rest", F.floor("target") - F.col("epochs") * F.col("source_size")).drop("held")
    )
    along = W.partitionBy("host", "cell").orderBy("key", "id", "size").rowsBetween(W.unboundedPreceding, 0)
    start = F.col("ahead") + F.sum("size").over(along) - F.col("size")
    partial = F.greatest(F.least(F.col("size"), F.col("rest") - start), F.lit(0))
    taken = (F.col("epochs") * F.col("size") + partial).cast("bigint")
    out = measured.join(plan, ["host", "cell"]).withColumn("taken", taken)
    return out.select("row.*", F.struct("size", "source_size", "target", "taken").alias(into)), into


def copies(mixed_rows: DataFrame, into: str, text: str = "text") -> DataFrame:
    """The rows of the mix: each document once per epoch it is taken in, numbered by `epoch`; a part keeps its first words."""
    epoch = free_name(mixed_rows, "epoch")
    n = F.when(F.col(f"{into}.size") > 0, F.ceil(F.col(f"{into}.taken") / F.col(f"{into}.size"))).otherwise(0)
    rows = mixed_rows.withColumn(epoch, F.explode(F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int")), lambda i: i <= n)))
    words = F.least(F.col(f"{into}.size"), F.col(f"{into}.taken") - (F.col(epoch) - 1) * F.col(f"{into}.size"))
    first = F.array_join(F.slice(F.filter(F.split(text, f"{BLANK_CLASS}+"), lambda w: w != ""), F.lit(1), words.cast("int")), " ")
    return rows.withColumn(text, F.when(words < F.col(f"{into}.size"), first).otherwise(F.col(text)))
