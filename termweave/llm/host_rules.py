"""Quality rules by host: rule failures summed by domain, shrunk towards an empirical beta prior, joined back.

Every step is a DataFrame expression. A document is judged in its own row, so repeated rows, null ids and clashing extra
columns need no key: all rows stay rows, and the counts live in one struct whose name the table does not use.

Defined results: a null text has no words and fails the base rules; a null host is a host of its own; an empty table gives an
empty result; a host that never fails has a small positive rate, as the prior says.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave.llm.common import BLANK_CLASS, BLANKS, free_name, written
from termweave.session import salted_join

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A measure with two limits: the loose one binds everywhere, the strict one where the host is suspect."""

    name: str
    measure: str
    loose: float
    strict: float


#: Measures are shares of words or lines, over the counts of `rule_counts`.
RULES = (
    Rule("symbols", "n_symbols / greatest(n_words, 1)", 0.5, 0.1),
    Rule("dup_lines", "n_dup_lines / greatest(n_lines, 1)", 0.6, 0.3),
    Rule("long_words", "word_chars / greatest(n_words, 1)", 20.0, 12.0),
    Rule("repeats", "n_repeat_words / greatest(n_words, 1)", 0.5, 0.35),
    Rule("short", "50 / greatest(n_words, 1)", 1.0, 0.8),
)
#: A host is suspect under a rule when its shrunk failure rate is above this.
SUSPECT_RATE = 0.5


def rule_counts(text: Column) -> dict[str, Column]:
    """The plain counts of a text; `words` and `lines` are arrays that later expressions share."""
    return {
        "words": F.coalesce(F.filter(F.split(text, BLANK_CLASS + "+"), lambda w: w != ""), F.array().cast("array<string>")),
        "lines": F.coalesce(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), F.array().cast("array<string>")),
        "word_chars": F.coalesce(F.length(F.translate(text, BLANKS, "")), F.lit(0)).cast("bigint"),
        "n_symbols": F.coalesce(F.length(text) - F.length(F.translate(text, SYMBOLS, "")), F.lit(0)).cast("bigint"),
    }


def with_counts(docs: DataFrame, text: str, keep: Sequence[str], into: str) -> DataFrame:
    """The kept columns and a struct of counts named `into`."""
    doc, c, s = (free_name(docs, n) for n in ("_doc", "_c", "_s"))
    base = docs.select(F.struct(*[F.col(k) for k in keep]).alias(doc), F.struct(*[v.alias(k) for k, v in rule_counts(F.col(text)).items()]).alias(c))
    base = base.select(doc, *[F.col(f"{c}.{k}").alias(f"{c}{k}") for k in ("words", "lines", "word_chars", "n_symbols")])
    words = F.col(f"{c}words")
    n = F.size(words)
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))))
    base = base.select("*", F.coalesce(windows, F.array().cast("array<bigint>")).alias(f"{c}hashes"))
    hashes = F.col(f"{c}hashes")
    span = F.greatest(F.size(hashes), F.lit(1)).cast("bigint")
    # One sort of hash and place packed in a long brings equal windows together.
    packed = F.sort_array(F.transform(hashes, lambda h, i: F.shiftright(h, 1) - F.pmod(F.shiftright(h, 1), span) + i))
    base = base.select("*", packed.alias(f"{c}packed"), span.alias(f"{c}span"))
    packed, span = F.col(f"{c}packed"), F.col(f"{c}span")

    def repeated(p: Column, k: Column) -> Column:
        place = F.pmod(p, span)

        def equal(other: Column) -> Column:
            near = F.get(packed, other)
            return F.when(near - F.pmod(near, span) == p - place, F.get(hashes, F.pmod(near, span).cast("int")) == F.get(hashes, place.cast("int")))

        return F.coalesce(equal(k - 1), F.lit(False)) | F.coalesce(equal(k + 1), F.lit(False))

    places = F.sort_array(F.transform(F.filter(packed, repeated), lambda p: F.pmod(p, span)))
    base = base.select("*", places.alias(f"{c}places"))
    places = F.col(f"{c}places")
    # Of the sorted places of repeated windows, each covers up to three words that the one before did not.
    covered = F.aggregate(
        F.transform(places, lambda p, k: F.least(F.lit(3).cast("bigint"), F.coalesce(p - F.get(places, k - 1), F.lit(3).cast("bigint")))),
        F.lit(0).cast("bigint"), lambda a, x: a + x,
    )
    lines = F.col(f"{c}lines")
    counts = {
        "n_words": n.cast("bigint"), "word_chars": F.col(f"{c}word_chars"), "n_symbols": F.col(f"{c}n_symbols"),
        "n_lines": F.size(lines).cast("bigint"), "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint"),
        "n_repeat_words": covered,
    }
    base = base.select(F.col(doc), F.struct(*[v.alias(k) for k, v in counts.items()]).alias(s))
    return base.select(*[F.col(f"{doc}.`{k}`").alias(k) for k in keep], F.col(s).alias(into))


def _measure(rule: Rule, counts: str) -> Column:
    expression = rule.measure
    for name in ("n_symbols", "n_words", "n_dup_lines", "n_lines", "word_chars", "n_repeat_words"):
        expression = expression.replace(name, f"{counts}.{name}")
    return F.expr(expression)


def host_verdicts(counted: DataFrame, host: Column, counts: str, rules: Sequence[Rule] = RULES, suspect: float = SUSPECT_RATE) -> DataFrame:
    """One row per host: under which rules it is suspect.

    Failures are summed by host (partial sums first, so a hot host is no hot task). Over hosts, the method of moments gives
    each rule a beta prior: the pooled rate, and a weight from the spread of the rates beyond binomial noise. The shrunk
    rate of a host is (failures + a) / (documents + a + b); few documents mean little say.
    """
    fails = [F.sum((_measure(r, counts) > r.strict).cast("bigint")).alias(r.name) for r in rules]
    hosts = counted.groupBy(host.alias("host")).agg(F.count("*").alias("n"), *fails)
    moments = hosts.agg(
        F.sum("n").alias("all_n"), F.count("*").alias("all_hosts"), F.sum(1 / F.col("n")).alias("inverse"),
        *[F.struct(F.sum(r.name).alias("f"), F.sum(F.col(r.name) / F.col("n")).alias("s1"), F.sum(F.pow(F.col(r.name) / F.col("n"), 2)).alias("s2")).alias(f"m_{r.name}") for r in rules],
    )
    joined = hosts.crossJoin(F.broadcast(moments))  # one row of sums
    verdicts = []
    for r in rules:
        m = F.col(f"m_{r.name}")
        mean = (m["f"] + 0.5) / (F.col("all_n") + 1.0)
        spread = m["s2"] / F.col("all_hosts") - F.pow(m["s1"] / F.col("all_hosts"), 2)
        between = F.greatest(spread - mean * (1 - mean) * F.col("inverse") / F.col("all_hosts"), mean * (1 - mean) * 1e-3)
        weight = F.greatest(mean * (1 - mean) / between - 1, F.lit(2.0))
        rate = (F.col(r.name) + mean * weight) / (F.col("n") + weight)
        verdicts.append((rate > suspect).alias(r.name))
    return joined.select("host", F.struct(*verdicts).alias("suspect"))


def host_rules(docs: DataFrame, text: str = "text", host: str = "source", keep: Sequence[str] | None = None, rules: Sequence[Rule] = RULES) -> tuple[DataFrame, str]:
    """The kept columns of every row and a struct (its name is the second value) with the counts, base_failed and kept.

    kept: no base failure, no rule beyond its loose limit, and none beyond its strict limit where the host is suspect.
    """
    keep = list(docs.columns if keep is None else keep)
    into = free_name(docs, "_rules")
    key = free_name(docs, "_host")
    # A null host is a host: "n", where others are "s" and their name.
    hosted = docs.withColumn(key, F.coalesce(F.concat(F.lit("s"), F.col(host)), F.lit("n")))
    counted = written(with_counts(hosted, text, [*keep, key], into), "op2-counts")
    verdicts = host_verdicts(counted, F.col(f"`{key}`"), into, rules)
    plain = counted.select(F.struct(*[F.col(f"`{k}`") for k in keep]).alias("doc"), F.col(f"`{key}`").alias("host"), F.col(into).alias("rules"))
    joined = salted_join(plain, verdicts, ["host"], ["doc"])
    c = lambda name: F.col(f"rules.{name}")
    failed = (c("n_words") < 50) | (100 * c("n_repeat_words") > 50 * c("n_words"))
    passes = ~failed
    for r in rules:
        measure = _measure(r, "rules")
        passes = passes & ~((measure > r.loose) | ((measure > r.strict) & F.col(f"suspect.{r.name}")))
    result = F.struct(F.col("rules.*"), failed.alias("base_failed"), passes.alias("kept"))
    return joined.select(*[F.col(f"doc.`{k}`").alias(k) for k in keep], result.alias(into)), into


def passing(docs: DataFrame) -> DataFrame:
    """The rows that the rules keep, with the columns they came with."""
    judged, rules = host_rules(docs)
    return judged.filter(F.col(f"{rules}.kept")).select(*[F.col(f"`{c}`") for c in docs.columns])
