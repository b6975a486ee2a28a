"""Language identification by partial matching: code lengths under byte context trees of each language.

A language's tree holds, for contexts of up to ORDER bytes, how often each byte followed. A byte costs -log2 of its probability in
the longest context the language knows; a byte that never followed there pays the escape probability (distinct followers over
all plus distinct) and is looked up one byte shorter, down to 1/256. Statistics are frozen after training, so the cost of
each (context, byte) is a table entry and a text's code length is an exact sum. The languages share one trie of contexts, walked
for all bytes of a batch at once; their counts and escapes stay apart.

Training reads a bounded sample (`Sample`); its counts are summed by Spark. Scoring reads every byte of every text.

Defined results: null texts and texts without a letter are `und` with score 0, as is all without a training row; equal code
lengths go to the first language by name. Rows are scored in place: repeated rows, null ids and extra columns need no care.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termweave.llm.common import in_slices, texts

ORDER = 4
UNKNOWN = "und"
_SLICE = 1 << 20


@dataclass(frozen=True)
class Sample:
    """Bounds of training: documents per language (by hash, about), bytes of a document that may be drawn, counted
    (context, byte) pairs, and bytes of the finished cost table."""

    documents: int = 400
    text_bytes: int = 1 << 16
    pairs: int = 400_000
    table_bytes: int = 48 << 20


@dataclass(frozen=True)
class Trees:
    """Counted strings (context and next byte): their length, code, language and count."""

    languages: tuple[str, ...]
    length: np.ndarray
    code: np.ndarray
    language: np.ndarray
    count: np.ndarray
    table_bytes: int
    name: str = field(default_factory=lambda: uuid.uuid4().hex)


def _count_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch and language, the strings of 1 to ORDER + 1 bytes and their counts; a code holds length and bytes."""
    for batch in batches:
        by_language: dict[str, list[np.ndarray]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), texts(batch, "text"), strict=True):
            data = np.frombuffer(text, np.uint8).astype(np.uint64)
            code = np.zeros(len(data), np.uint64)
            for length in range(1, min(ORDER + 1, len(data)) + 1):
                n = len(data) - length + 1
                code = (code[:n] << np.uint64(8)) | data[length - 1 :]
                by_language.setdefault(lang, []).append(code | np.uint64(length << 48))
        for lang, codes in by_language.items():
            found, n = np.unique(np.concatenate(codes), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found)), pa.array(found.view(np.int64)), pa.array(n)], names=["lang", "code", "n"])


def fit(rows: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: Sample = Sample()) -> Trees:
    """Count contexts over a hashed sample of the given training rows."""
    usable = rows.select(F.col(key).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")).filter(
        F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.octet_length("text") <= sample.text_bytes))
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row per language
    share = F.lit(0.0)
    for name, n in sizes.items():
        share = F.when(F.col("lang") == name, F.lit(min(1.0, sample.documents / n))).otherwise(share)
    drawn = usable.filter(F.pmod(F.xxhash64("id", "lang"), F.lit(1 << 30)) < share * (1 << 30))
    counts = drawn.select("lang", "text").mapInArrow(_count_strings, "lang string, code bigint, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "code", "lang").limit(sample.pairs).toPandas()
    languages = tuple(sorted(set(top["lang"])))
    code = top["code"].to_numpy(np.int64).view(np.uint64)
    index = {name: i for i, name in enumerate(languages)}
    return Trees(
        languages, (code >> np.uint64(48)).astype(np.int64), (code & np.uint64((1 << 48) - 1)).astype(np.int64),
        top["lang"].map(index).to_numpy(np.int64) if languages else np.empty(0, np.int64), top["n"].to_numpy(np.int64), sample.table_bytes)


class Scorer:
    """The trie and its cost table: children by (context, older byte), bits by (context, byte, language)."""

    def __init__(self, trees: Trees):
        self.languages = trees.languages
        many = max(1, len(trees.languages))
        seen = np.unique(trees.code[trees.length == 1])
        self.classes = np.zeros(256, np.int32)  # 0: bytes that no training text has
        self.classes[seen] = np.arange(1, len(seen) + 1)
        width = len(seen) + 1
        limit = max(1, trees.table_bytes // (4 * width * many))
        context, follower = trees.code >> 8, trees.code & 255
        depth = trees.length - 1
        whole = np.bincount(trees.language[depth == 0], weights=trees.count[depth == 0], minlength=many)
        keys, where = np.unique((depth << 48) | context, return_inverse=True)
        totals = np.bincount(where, weights=trees.count, minlength=len(keys))
        order = np.lexsort((keys, -totals))[:limit]
        nodes: dict[int, int] = {0: 0}
        for k in sorted(keys[order].tolist()):  # by depth, so that a shorter context comes first
            d, c = k >> 48, k & ((1 << 48) - 1)
            if d and ((d - 1) << 48 | c & ((1 << 8 * (d - 1)) - 1)) in nodes:
                nodes[k] = len(nodes)
        self.dead = len(nodes)
        self.child = np.full((len(nodes) + 1, width), self.dead, np.int32)
        parent = np.zeros(len(nodes), np.int64)
        for k, node in nodes.items():
            d, c = k >> 48, k & ((1 << 48) - 1)
            if d:
                parent[node] = nodes[(d - 1) << 48 | c & ((1 << 8 * (d - 1)) - 1)]
                self.child[parent[node], self.classes[c >> 8 * (d - 1)]] = node
        row_node = np.array([nodes.get(k, -1) for k in keys.tolist()], np.int64)[where] if len(keys) else np.empty(0, np.int64)
        kept = row_node >= 0
        node, lang, count, byte = row_node[kept], trees.language[kept], trees.count[kept], self.classes[follower[kept]]
        total = np.zeros((len(nodes), many))
        distinct = np.zeros((len(nodes), many))
        np.add.at(total, (node, lang), count)
        np.add.at(distinct, (node, lang), 1)
        known = total > 0
        escape = np.where(known, distinct / np.maximum(total + distinct, 1), 1.0)
        chance = np.empty((len(nodes), width, many), np.float32)
        depths = np.array([k >> 48 for k in nodes])
        by_depth = depths[node]
        for d in range(ORDER + 1):
            at = np.flatnonzero(depths == d)
            below = np.full((1, width, many), 1 / 256) if d == 0 else chance[parent[at]]
            chance[at] = escape[at][:, None, :] * below
            rows = np.flatnonzero(by_depth == d)
            n, b, g = node[rows], byte[rows], lang[rows]
            chance[n, b, g] = count[rows] / (total[n, g] + distinct[n, g])
        np.log2(chance, out=chance)
        np.negative(chance, out=chance)
        self.bits = chance.reshape(len(nodes) * width, many)
        self.width = width
        self.ready = bool(trees.languages) and whole.sum() > 0

    def code_lengths(self, data: list[bytes]) -> np.ndarray:
        """Bits of each text under each language."""
        sizes = np.array([len(d) for d in data], np.int64)
        pad = b"\0" * ORDER
        joined = self.classes[np.frombuffer(pad + pad.join(data), np.uint8)]
        begins = ORDER + np.concatenate([[0], np.cumsum(sizes + ORDER)[:-1]]).astype(np.int64)
        for k in range(1, ORDER + 1):  # no context reaches over a text's start
            joined[begins - k] = 0
        out = np.zeros((len(data), self.bits.shape[1]))
        for start in range(ORDER, len(joined), _SLICE):
            end = min(len(joined), start + _SLICE)
            here = joined[start:end]
            node = best = np.zeros(end - start, np.int32)
            for k in range(1, ORDER + 1):
                node = self.child[node, joined[start - k : end - k]]
                best = np.where(node == self.dead, best, node)
            bits = self.bits[best.astype(np.int64) * self.width + here]
            first = np.searchsorted(begins + sizes, start, "right")
            last = np.searchsorted(begins, end, "left")
            if last <= first:
                continue
            low = np.maximum(begins[first:last], start) - start
            high = np.minimum(begins[first:last] + sizes[first:last], end) - start
            cuts = np.stack([low, high], axis=1).ravel()
            padded = np.concatenate([bits, np.zeros((1, bits.shape[1]), bits.dtype)])
            sums = np.add.reduceat(padded, cuts, axis=0, dtype=np.float64)[::2]
            out[first:last] += np.where((high > low)[:, None], sums, 0.0)
        return out


_SCORERS: dict[str, Scorer] = {}


def _scorer(trees: Trees) -> Scorer:
    """Built once per Python worker and training."""
    if trees.name not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[trees.name] = Scorer(trees)
    return _SCORERS[trees.name]


def language(text: Column, trees: Trees) -> Column:
    """struct(lang_pred, score): the language of least code length, and its posterior among the learned ones."""

    @F.arrow_udf(T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
    def predict(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = _scorer(trees)
        for values in columns:
            names, scores = [], []
            for part in in_slices([pa.RecordBatch.from_arrays([pc.fill_null(values, "")], names=["text"])], "text", _SLICE):
                bits = own.code_lengths(list(texts(part, "text")))
                best = bits.argmin(axis=1)
                weight = np.exp2(-np.minimum(bits - bits.min(axis=1, keepdims=True), 1000.0))
                names += [own.languages[b] if own.ready else UNKNOWN for b in best]
                scores += (1 / weight.sum(axis=1)).tolist()
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    none = F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    if not trees.languages:
        return none
    return F.when(F.coalesce(text.rlike(r"\p{L}"), F.lit(False)), predict(text)).otherwise(none)
