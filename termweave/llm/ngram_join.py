"""N-gram Jaccard join: a grouped prefix join over sets of word shingles, and the components its links make.

Two sets that are similar enough share a token among their first few in any one order of all tokens. The order here is by
hash, with frequent tokens last; how many tokens count as frequent only moves work, never results.

1. Documents with equal sets are one class, named by its smallest id.
2. Classes with the same size and the same prefix are one group; only groups are posted under their prefix tokens.
3. A first round verifies each group against the smallest one under each of its tokens, and members against their group's
   first. Its links are contracted to components.
4. The second round takes all candidates that the first left in different components: pairs of (group, component) under a
   common token, the largest component of a token never against itself. A pair needs enough common prefix tokens for the
   sizes of its sets, so it meets under one that is early enough in both prefixes; then the prefixes are compared. What passes is expanded to members and verified on whole sets.

So a group of near copies costs a star, not all its pairs, and no link between different components is lost.

Defined results: a text without words has an empty set and is its own component; a null id has a null component and links with
nothing; rows that repeat an id with different texts give a row each. Extra columns are not read.
Shingles are 64-bit hashes; sets compare by these hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave.llm.common import discard, texts, written
from termweave.llm.components import components

_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class JoinOptions:
    """words: shingle length; percent: least Jaccard similarity in hundredths.

    frequent, most_frequent: tokens in at least so many documents, and no more than so many of them, go last in the order.
    """

    words: int = 5
    percent: int = 80
    frequent: int = 16
    most_frequent: int = 1 << 18


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 1 << 16:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = _WordHashes()


def shingles(text: bytes, words: int) -> np.ndarray:
    """The distinct hashed shingles of a text, ascending."""
    split = text.lower().split()
    if not split:
        return np.empty(0, np.uint64)
    if len(split) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(split), seed=len(split))], np.uint64)
    hashes = np.fromiter(map(_HASHES.__getitem__, split), np.uint64, len(split))
    n = len(split) - words + 1
    mixed = hashes[:n].copy()
    for i in range(1, words):
        mixed ^= mixed >> np.uint64(29)
        mixed *= _MIX
        mixed += hashes[i : n + i]
    mixed ^= mixed >> np.uint64(32)
    mixed *= _MIX
    return np.unique(mixed)


def prefix_size(n: int, percent: int) -> int:
    return n + (-percent * n // 100) + 1


def _digest(values: np.ndarray) -> tuple[int, int]:
    raw = xxhash.xxh3_128_digest(values.tobytes())
    return int.from_bytes(raw[:8], "big", signed=True), int.from_bytes(raw[8:], "big", signed=True)


def frequent_tokens(docs: DataFrame, text: str, options: JoinOptions) -> tuple[np.ndarray, np.ndarray]:
    """Upper halves of frequent tokens, ascending, and the documents they are in.

    All tokens of all documents are counted. The list has at most `most_frequent` entries of 12 bytes.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def counted() -> pa.RecordBatch:
            tokens, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.record_batch({"token": tokens.view(np.int32), "n": n.astype(np.int32)})

        for batch in batches:
            for value in texts(batch, text):
                found = shingles(value, options.words)
                if len(found):
                    upper = (found >> np.uint64(32)).astype(np.uint32)  # ascending, as the tokens are
                    held.append(upper[np.concatenate([[True], upper[1:] != upper[:-1]])])
                    size += len(found)
                if size > 1 << 20:
                    yield counted()
                    size = 0
        if held:
            yield counted()

    # Batches are counted already, so rows go to their token's task as they are.
    counts = docs.select(text).mapInArrow(count, "token int, n int").repartition("token").groupBy("token").agg(F.sum("n").alias("n"))
    often = written(counts.filter(F.col("n") >= options.frequent), "op9-frequent")
    top = often.orderBy(F.desc("n"), "token").limit(options.most_frequent).toPandas()
    discard(often)
    tokens = top["token"].to_numpy(np.int32).view(np.uint32)
    order = np.argsort(tokens)
    return tokens[order], top["n"].to_numpy(np.int64)[order]


def _ordered(found: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Tokens by the common order: rare ones by hash, then frequent ones by count and hash."""
    names, counts = frequent
    if not len(names):
        return found
    upper = (found >> np.uint64(32)).astype(np.uint32)
    at = np.minimum(np.searchsorted(names, upper), len(names) - 1)
    weight = np.where(names[at] == upper, counts[at], 0)
    return found if not weight.any() else found[np.lexsort((found, weight))]


def heads(docs: DataFrame, key: str, text: str, options: JoinOptions, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Per row: id, set size, digests of set and prefix, and the prefix where another set can be similar."""
    least = next(n for n in range(1, 101) if 100 * n >= options.percent * (n + 1)) if options.percent < 100 else 1 << 62

    def head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digests, prefixes = [], [], []
            for value in texts(batch, text):
                found = shingles(value, options.words)
                prefix = _ordered(found, frequent)[: prefix_size(len(found), options.percent)] if len(found) >= least else found[:0]
                n.append(len(found))
                digests.append((*_digest(found), *_digest(prefix)))
                prefixes.append(prefix.view(np.int64))
            columns = list(zip(*digests, strict=True)) if digests else [[], [], [], []]
            lists = pa.ListArray.from_arrays(
                np.cumsum([0, *map(len, prefixes)], dtype=np.int32), pa.array(np.concatenate([np.empty(0, np.int64), *prefixes])))
            yield pa.RecordBatch.from_arrays(
                [batch.column(key).cast(pa.int64()), pa.array(n, pa.int32()), *[pa.array(c, pa.int64()) for c in columns], lists],
                names=["id", "n", "s1", "s2", "p1", "p2", "prefix"])

    return docs.select(F.col(key).cast("bigint").alias(key), text).mapInArrow(head, "id bigint, n int, s1 bigint, s2 bigint, p1 bigint, p2 bigint, prefix array<bigint>")


def _need(n1: Column, n2: Column, percent: int) -> Column:
    """Common tokens that two sizes need."""
    return F.ceil((n1 + n2) * percent / F.lit(100 + percent) - 1e-9)


def _common_prefix_tokens(n1: Column, n2: Column, percent: int) -> Column:
    """Common prefix tokens without which the rest of the sets cannot reach the similarity."""
    rest = lambda n: F.ceil(n * percent / F.lit(100) - 1e-9) - 1
    return F.greatest(_need(n1, n2, percent) - F.greatest(rest(n1), rest(n2)), F.lit(1))


def _prefix_column(n: Column, percent: int) -> Column:
    """`prefix_size` of a column."""
    return n - F.ceil(n * percent / F.lit(100) - 1e-9) + 1


def _sizes_fit(n1: Column, n2: Column, percent: int) -> Column:
    return 100 * F.least(n1, n2) >= percent * F.greatest(n1, n2)


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, key: str, text: str, options: JoinOptions) -> DataFrame:
    """The pairs (u, v) of class names whose whole sets are similar enough."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(value, options.words).view(np.int64) for value in texts(batch, text)]
            lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, found)], dtype=np.int32), pa.array(np.concatenate([np.empty(0, np.int64), *found])))
            marks = list(zip(*[_digest(f) for f in found], strict=True)) if found else [[], []]
            yield pa.RecordBatch.from_arrays([batch.column(key), lists, *[pa.array(m, pa.int64()) for m in marks]], names=["id", "tokens", "s1", "s2"])

    wanted = pairs.select(F.col("u").alias("id")).union(pairs.select(F.col("v").alias("id"))).distinct()
    marks = classes.join(wanted, F.col("rep") == F.col("id"), "left_semi").select(F.col("rep").alias("id"), "s1", "s2")
    asked = docs.select(F.col(key).cast("bigint").alias(key), text).join(wanted.withColumnRenamed("id", key).hint("merge"), key, "left_semi")
    table = written(asked.mapInArrow(sets, "id bigint, tokens array<bigint>, s1 bigint, s2 bigint").join(marks, ["id", "s1", "s2"], "left_semi").select("id", "tokens"), "op9-sets")
    left = table.select(F.col("id").alias("u"), F.col("tokens").alias("a"))
    right = table.select(F.col("id").alias("v"), F.col("tokens").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    links = pairs.join(left, "u").join(right, "v").filter(100 * both >= options.percent * (F.size("a") + F.size("b") - both))
    found = written(links.select("u", "v").distinct(), "op9-links")
    discard(table)
    return found


def similar(docs: DataFrame, key: str = "doc_id", text: str = "text", options: JoinOptions = JoinOptions()) -> DataFrame:
    """(id, n_shingles, component_id) of every row; component_id is the smallest id reachable by links."""
    percent = options.percent
    frequent = frequent_tokens(docs, text, options)
    rows = written(heads(docs, key, text, options, frequent), "op9-heads")
    named = rows.filter("n > 0 AND id IS NOT NULL")
    classes = written(named.groupBy("n", "s1", "s2").agg(F.min("id").alias("rep"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.max(F.size("prefix") > 0).alias("open")), "op9-classes")
    grouped = classes.filter("open").groupBy("n", "p1", "p2").agg(F.min("rep").alias("gid"), F.count("*").alias("classes"))
    groups = written(grouped, "op9-groups")
    members = classes.filter("open").join(groups, ["n", "p1", "p2"]).select("gid", "rep", "n", "classes")

    first = named.join(groups.select(F.col("gid").alias("id"), "n", "p1", "p2"), ["id", "n", "p1", "p2"], "left_semi")
    postings = first.select(F.col("id").alias("gid"), "n", F.posexplode("prefix").alias("pos", "token"))
    # Written, so that the join shuffles both of its sides and Spark can split a hot token.
    ends = written(postings.groupBy("token").agg(F.min("gid").alias("low"), F.max("gid").alias("high")).filter("low < high").select("token", "low"), "op9-ends")
    shared = written(postings.join(ends, "token").select("token", "gid", "n", "pos", "low"), "op9-shared")

    sizes = groups.select("gid", "n")
    stars = shared.filter("gid <> low").groupBy("gid", "low", "n").agg(F.count("*").alias("common"))
    stars = stars.join(sizes.select(F.col("gid").alias("low"), F.col("n").alias("m")), "low").filter(
        _sizes_fit(F.col("n"), F.col("m"), percent) & (2 * F.col("common") >= _common_prefix_tokens(F.col("n"), F.col("m"), percent)))
    inside = members.filter("rep <> gid").select(F.col("rep").alias("u"), F.col("gid").alias("v"))
    pairs = written(stars.select(F.col("gid").alias("u"), F.col("low").alias("v")).union(inside).distinct(), "op9-stars")
    links = verified(pairs, classes, docs, key, text, options)
    label = components(links, "op9-first")

    units = members.join(label.withColumnRenamed("node", "rep"), "rep", "left").select("gid", "rep", "n", "classes", F.coalesce("component", "rep").alias("comp"))
    units = written(units, "op9-units")
    posted = shared.select("token", "gid", "pos").join(units.select("gid", "n", "comp").distinct(), "gid")
    sides = posted.groupBy("token", "comp").agg(F.count("*").alias("c")).groupBy("token").agg(F.max(F.struct("c", "comp")).alias("top"), F.count("*").alias("comps"))
    mixed = written(posted.join(sides.filter("comps > 1").select("token", F.col("top.comp").alias("major")), "token"), "op9-mixed")
    a = mixed.filter("comp <> major").select("token", *[F.col(c).alias(f"{c}1") for c in ("gid", "comp", "n", "pos")])
    b = mixed.select("token", "major", *[F.col(c).alias(f"{c}2") for c in ("gid", "comp", "n", "pos")])
    # Prefixes with `least` common tokens share one that is in both before the last `least - 1`.
    least = _common_prefix_tokens(F.col("n1"), F.col("n2"), percent)
    early = (F.col("pos1") <= _prefix_column(F.col("n1"), percent) - least) & (F.col("pos2") <= _prefix_column(F.col("n2"), percent) - least)
    crossed = a.join(b, "token").filter(
        "comp1 <> comp2 AND (comp2 = major OR comp1 < comp2)").filter(_sizes_fit(F.col("n1"), F.col("n2"), percent) & early)
    crossed = crossed.select(
        *[F.when(F.col("comp1") < F.col("comp2"), F.col(f"{c}{i}")).otherwise(F.col(f"{c}{3 - i}")).alias(f"{c}{i}") for i in (1, 2) for c in ("gid", "comp", "n")])
    prefix = lambda i: first.select(F.col("id").alias(f"gid{i}"), F.col("prefix").alias(f"prefix{i}")).dropDuplicates([f"gid{i}"])
    paired = crossed.distinct().join(prefix(1), "gid1").join(prefix(2), "gid2")
    candidates = paired.filter(F.size(F.array_intersect("prefix1", "prefix2")) >= least).select("gid1", "comp1", "gid2", "comp2")
    member = lambda i: units.select(F.col("gid").alias(f"gid{i}"), F.col("comp").alias(f"comp{i}"), F.col("rep").alias(f"rep{i}"))
    across = candidates.join(member(1), ["gid1", "comp1"]).join(member(2), ["gid2", "comp2"]).select(F.col("rep1").alias("u"), F.col("rep2").alias("v"))
    # Members of one group in different components: those outside the first member's component against all.
    own = units.filter("classes > 1").join(label.select(F.col("node").alias("gid"), F.col("component").alias("top")), "gid", "left").withColumn("top", F.coalesce("top", "gid"))
    within = own.filter("comp <> top").select("gid", F.col("rep").alias("u"), F.col("comp").alias("comp1")).join(
        own.select("gid", F.col("rep").alias("v"), F.col("comp").alias("comp2"), "top"), "gid").filter("comp1 <> comp2 AND (comp2 = top OR comp1 < comp2)").select("u", "v")
    more = written(across.union(within).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().join(
        pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), ["u", "v"], "left_anti"), "op9-more")
    for table in (ends, shared, mixed, units, groups, pairs):
        discard(table)
    if not more.isEmpty():
        extra = verified(more, classes, docs, key, text, options)
        label = components(links.union(extra), "op9-second")
        discard(extra)
    names = classes.join(label.withColumnRenamed("node", "rep"), "rep", "left").select("n", "s1", "s2", F.coalesce("component", "rep").alias("component_id"))
    result = rows.select("id", "n", "s1", "s2").join(names.withColumnRenamed("n", "m").select("m", "s1", "s2", "component_id"), ["s1", "s2"], "left")
    return result.select("id", F.col("n").cast("bigint").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.when(F.col("n") > 0, F.coalesce("component_id", "id")).otherwise(F.col("id"))).alias("component_id"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", options: JoinOptions = JoinOptions()) -> DataFrame:
    """The documents without the later ones of each component, with the columns they came with.

    The row with the component's smallest id stays; of rows that repeat that id, the least by all columns. Rows with a null id stay.
    """
    found = written(similar(docs, key, text, options), "op9-result")
    chosen = found.groupBy("id").agg(F.min("component_id").alias("component_id"), F.count("*").alias("rows")).filter("id = component_id")
    name = lambda ids: ids.select(F.col("id").alias("_id"))
    plain = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    at = F.col(f"doc.`{key}`").cast("bigint")
    once = plain.join(name(chosen.filter("rows = 1")), at == F.col("_id"), "left_semi")
    again = plain.join(name(chosen.filter("rows > 1")), at == F.col("_id"), "left_semi").groupBy(at.alias("_id")).agg(F.min("doc").alias("doc")).select("doc")
    kept = once.union(again).union(plain.filter(at.isNull()))
    return kept.select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])
