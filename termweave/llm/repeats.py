"""Removal of repeated byte strings: suffix buckets resolved block by block with the names of a cover sample.

A byte goes when a string of `length` bytes over it also starts anywhere else. All suffixes of all texts are too many to
move, so the work is split as in blockwise suffix sorting: a cover sample of positions is named first, suffixes are put in
buckets by the sample they pass through, and long ties inside a bucket are settled by names of blocks, never by whole texts.
Only equality matters here, so names are 128-bit hashes (a sample's, and the block's) in place of ranks, and grouping takes
the place of sorting; no bucket is ever held by one task.

1. Cover (`cover.anchors`): every string start belongs to one anchor; starts of equal strings are at the same distance from
   equal anchors. An anchor that occurs once settles its starts: nothing there repeats.
2. Where an anchor occurs with equal surroundings (all bytes its starts can reach), all its starts repeat.
3. Other occurrences of repeated anchors are ties. One context for each different surrounding is cut out of its text. Its
   starts are taken in blocks of BLOCK distances: a block whose common bytes occur once settles; one whose reach occurs
   twice repeats; what is left is settled start by start.

Defined results: null and empty texts have nothing to remove; a text shorter than `length` stays whole; equal rows are elsewhere
to each other, so a repeated text of `length` bytes or more goes entirely, all copies. Rows are found again by a hash of
their text, so null and repeated ids and extra columns need no care.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termweave.llm.common import discard, free_name, texts, written
from termweave.llm.cover import anchors

BLOCK = 10


def _signed(values) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _text_key(text: Column) -> Column:
    """16 bytes that name a text."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def _occurrences(bodies: DataFrame, length: int) -> DataFrame:
    """Each anchor of each text: place, first and last start, its name, and the name of its surroundings."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, counts, columns, around = batch.column("key"), [], [], []
            for value in texts(batch, "text"):
                place, low, high, names = anchors(value, length)
                counts.append(len(place))
                columns.append((place, low, high, names))
                around += [xxhash.xxh3_64_intdigest(value[a : b + length], p - a) for p, a, b in zip(place.tolist(), low.tolist(), high.tolist(), strict=True)]
            if not around:
                continue
            place, low, high, names = map(np.concatenate, zip(*columns, strict=True))
            rows = keys.take(pa.array(np.repeat(np.arange(len(counts)), counts)))
            yield pa.RecordBatch.from_arrays(
                [rows, *[pa.array(c.astype(np.int32)) for c in (place, low, high)], _signed(names), _signed(around)],
                names=["key", "pos", "low", "high", "anchor", "around"])

    return bodies.filter(F.octet_length("text") >= length).mapInArrow(found, "key binary, pos int, low int, high int, anchor bigint, around bigint")


def _contexts(bodies: DataFrame, probes: DataFrame, length: int) -> DataFrame:
    """The bytes that the starts of each probed occurrence can reach."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, context, parts = [], [], []
            for i, (value, asked) in enumerate(zip(texts(batch, "text"), batch.column("asked"), strict=True)):
                for p in asked.as_py():
                    rows.append(i)
                    parts.append((p["anchor"], p["single"], p["pos"], p["low"], p["high"]))
                    context.append(value[p["low"] : p["high"] + length])
            if rows:
                columns = [pa.array(c, t) for c, t in zip(zip(*parts, strict=True), (pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.int32()), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(rows)), *columns, pa.array(context, pa.binary())], names=["key", "anchor", "single", "pos", "low", "high", "context"])

    asked = probes.groupBy("key").agg(F.collect_list(F.struct("anchor", "single", "pos", "low", "high")).alias("asked"))
    rows = bodies.select("key", "text").join(asked.hint("shuffle_hash"), "key")
    return rows.mapInArrow(cut, "key binary, anchor bigint, single boolean, pos int, low int, high int, context binary").dropDuplicates(["key", "pos"])


def _blocks(contexts: DataFrame, length: int) -> DataFrame:
    """Per context and block of distances: the starts, and the names of the block's common bytes and of its reach."""

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            rows, ranges, core, reach = [], [], [], []
            places = zip(*[batch.column(c).to_pylist() for c in ("pos", "low", "high", "context")], strict=True)
            for i, (pos, low, high, context) in enumerate(places):
                for block in range((pos - high) // BLOCK, (pos - low) // BLOCK + 1):
                    near, far = block * BLOCK, block * BLOCK + BLOCK - 1
                    first, last = max(low, pos - far), min(high, pos - near)
                    rows.append(i)
                    ranges.append((first, last))
                    core.append(digest(context[pos - near - low : pos - far + length - low], block))
                    reach.append(digest(context[first - low : last + length - low], pos - first))
            if rows:
                take = pa.array(rows)
                first, last = zip(*ranges, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).take(take) for c in ("key", "anchor", "single", "pos")], pa.array(first, pa.int32()), pa.array(last, pa.int32()), _signed(core), _signed(reach)],
                    names=["key", "anchor", "single", "pos", "first", "last", "core", "reach"])

    kept = contexts.select("key", "anchor", "single", "pos", "low", "high", "context")
    return kept.mapInArrow(named, "key binary, anchor bigint, single boolean, pos int, first int, last int, core bigint, reach bigint")


def _starts(blocks: DataFrame, contexts: DataFrame, length: int) -> DataFrame:
    """Each start of the given blocks with the name of its string."""

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, starts, names = [], [], []
            places = zip(*[batch.column(c).to_pylist() for c in ("low", "first", "last", "context")], strict=True)
            for i, (low, first, last, context) in enumerate(places):
                for s in range(first, last + 1):
                    rows.append(i)
                    starts.append(s)
                    names.append(xxhash.xxh3_64_intdigest(context[s - low : s - low + length]))
            if rows:
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).take(take) for c in ("key", "anchor", "single")], pa.array(starts, pa.int32()), _signed(names)],
                    names=["key", "anchor", "single", "start", "name"])

    rows = blocks.select("key", "pos", "anchor", "single", "first", "last").join(contexts.select("key", "pos", "low", "context"), ["key", "pos"])
    return rows.select("key", "anchor", "single", "low", "first", "last", "context").mapInArrow(named, "key binary, anchor bigint, single boolean, start int, name bigint")


def _ties(rows: DataFrame, bucket: list[str], name: str) -> DataFrame:
    """The buckets with two rows or more, and whether they hold different names; partial counts first.

    Written, so that joins on it shuffle both of their sides and Spark can split a hot bucket.
    """
    ends = rows.groupBy(*bucket).agg(F.count("*").alias("n"), F.min(name).alias("a"), F.max(name).alias("b"))
    return written(ends.filter("n > 1").select(*bucket, (F.col("a") != F.col("b")).alias("mixed")), "op10-ties")


def repeated_starts(bodies: DataFrame, length: int) -> DataFrame:
    """(key, first, last): runs of starts, by text, whose strings occur elsewhere. bodies: key, text."""
    seen = written(_occurrences(bodies, length), "op10-anchors")
    found = seen.join(_ties(seen, ["anchor"], "around"), "anchor")
    found = written(found, "op10-repeated")
    discard(seen)
    # Of the mixed buckets, one row for each different surrounding.
    tied = found.filter("mixed").groupBy("anchor", "around").agg(F.count("*").alias("n"), F.min(F.struct("key", "pos", "low", "high")).alias("one"))
    tied = written(tied.select("anchor", "around", (F.col("n") == 1).alias("single"), "one.*"), "op10-tied")
    plural = tied.filter("NOT single").select("anchor", "around")
    settled = found.filter("NOT mixed").select("key", F.col("low").alias("first"), F.col("high").alias("last")).union(
        found.filter("mixed").join(plural, ["anchor", "around"], "left_semi").select("key", "low", "high"))
    settled = written(settled.distinct(), "op10-settled")
    discard(found)

    contexts = written(_contexts(bodies, tied, length), "op10-contexts")
    discard(tied)
    blocks = written(_blocks(contexts, length), "op10-blocks")
    open_blocks = written(blocks.join(_ties(blocks, ["anchor", "core"], "reach"), ["anchor", "core"]), "op10-open")
    discard(blocks)
    reaches = open_blocks.filter("mixed").groupBy("anchor", "core", "reach").agg(F.count("*").alias("n"), F.min(F.struct("key", "pos", "first", "last", "single")).alias("one"))
    reaches = written(reaches, "op10-reaches")
    many = reaches.filter("n > 1").select("anchor", "core", "reach")
    by_block = open_blocks.filter("single AND NOT mixed").select("key", "first", "last").union(
        open_blocks.filter("single AND mixed").join(many, ["anchor", "core", "reach"], "left_semi").select("key", "first", "last"))
    left = reaches.select("anchor", "one.key", "one.pos", "one.first", "one.last", (F.col("one.single") & (F.col("n") == 1)).alias("single"))
    starts = written(_starts(left, contexts, length), "op10-starts")
    discard(contexts)
    twice = starts.groupBy("anchor", "name").agg(F.count("*").alias("n")).filter("n > 1").select("anchor", "name")
    by_start = starts.filter("single").join(twice, ["anchor", "name"], "left_semi").select("key", F.col("start").alias("first"), F.col("start").alias("last"))
    result = written(settled.union(by_block).union(by_start), "op10-runs")
    for table in (settled, open_blocks, reaches, starts):
        discard(table)
    return result


def without_repeats(docs: DataFrame, length: int = 200, text: str = "text") -> tuple[DataFrame, str]:
    """Every row with its columns and a struct (its name is the second value): kept (binary), n_bytes, n_removed, n_spans."""
    into = free_name(docs, "_kept")
    others = [c for c in docs.columns if c != text]
    bodies = docs.select(_text_key(F.coalesce(F.col(text), F.lit(""))).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    runs = repeated_starts(bodies, length)
    # A text of several rows repeats as a whole.
    whole = bodies.groupBy("key").agg(F.count("*").alias("n"), F.max(F.octet_length("text")).alias("size")).filter((F.col("n") > 1) & (F.col("size") >= length))
    whole = written(whole.select("key", "size"), "op10-whole")
    spans = runs.join(whole, "key", "left_anti").union(whole.select("key", F.lit(0), F.col("size") - length))
    asked = spans.groupBy("key").agg(F.collect_list(F.struct("first", "last")).alias("runs"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, removed, count = [], [], []
            for value, row in zip(texts(batch, "text"), batch.column("runs"), strict=True):
                parts, at, gone, n = [], 0, 0, 0
                for first, last in _merged(row, length):
                    parts.append(value[at:first])
                    gone += last - first
                    n += 1
                    at = last
                parts.append(value[at:])
                kept.append(b"".join(parts))
                removed.append(gone)
                count.append(n)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(kept, pa.binary()), pa.array(removed, pa.int64()), pa.array(count, pa.int64())], names=["doc", "kept", "n_removed", "n_spans"])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("doc"), _text_key(F.coalesce(F.col(text), F.lit(""))).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    joined = rows.join(asked.hint("shuffle_hash"), "key", "left").select("doc", "text", "runs")
    schema = T.StructType([joined.schema["doc"], T.StructField("kept", T.BinaryType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType())])
    done = joined.mapInArrow(cut, schema)
    counts = F.struct("kept", (F.octet_length("kept") + F.col("n_removed")).cast("bigint").alias("n_bytes"), "n_removed", "n_spans")
    return done.select(*[F.col(f"doc.`{c}`").alias(c) for c in others], counts.alias(into)), into


def _merged(row, length: int) -> list[tuple[int, int]]:
    """Runs of starts as maximal runs of bytes."""
    merged: list[list[int]] = []
    for run in sorted((r["first"], r["last"] + length) for r in row.as_py() or []):
        if merged and run[0] <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], run[1])
        else:
            merged.append(list(run))
    return [tuple(m) for m in merged]


def without_repeated_text(docs: DataFrame, length: int = 200, text: str = "text", chars: str = "n_chars") -> DataFrame:
    """The documents with what is left of their texts, and the columns they came with.

    A character cut in half goes with its bytes; a null text stays null; the column `chars`, if there is one, follows the text.
    """
    done, into = without_repeats(docs.withColumn(free_name(docs, "_null"), F.col(text).isNull()), length, text)

    @F.arrow_udf(T.StringType())
    def whole_characters(values: pa.Array) -> pa.Array:
        return pa.array([v.as_py().decode("utf-8", "ignore") for v in values], pa.string())

    kept = F.col(f"{into}.kept")
    left = F.when(~F.col(free_name(docs, "_null")), F.when(F.col(f"{into}.n_removed") > 0, whole_characters(kept)).otherwise(kept.cast("string")))
    again = done.withColumn(text, left) if text not in done.columns else done
    if chars in docs.columns:
        again = again.withColumn(chars, F.when(F.col(f"{into}.n_removed") > 0, F.length(text).cast(docs.schema[chars].dataType)).otherwise(F.col(chars)))
    return again.select(*[F.col(f"`{c}`") for c in docs.columns])
