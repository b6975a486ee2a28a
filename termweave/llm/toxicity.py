"""Toxicity by compression distance: windows of a text are compressed with a dictionary of each class.

Two zstandard dictionaries are made from labelled text, each from the documents of its class. That of ordinary text holds
its most frequent strings (word beginnings). That of toxic text holds the same and, before them, the strings that are far more
frequent in toxic documents (by a two-proportion score over documents); the other has blanks in their place, so that both are
of one size and a common string costs the same in both. A window that the toxic dictionary shortens more holds toxic strings.
How often a text's windows of two sizes gain 1, 2, ... bytes is turned into a score by a logistic calibration on labelled
documents that did not make the dictionaries; both classes weigh the same in it, so that 0.5 is where a text is as likely
under one class as under the other, however rare the toxic class is.

Learning reads a bounded sample (`Sample`) with counts summed by Spark; of a text longer than `text_bytes` it reads a stretch
drawn by its hash. Scoring compresses every window of every whole text.

Defined results: null and empty texts are one blank window; without labels of both classes every score is 0. Rows are
scored in place: repeated rows, null ids and extra columns need no care. A label that is null is no label; of different texts
under one id the one of smallest hash is learned.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termweave.llm.common import texts, written

#: Bytes of a window, and how many of them the next one repeats.
WINDOWS = ((48, 12), (96, 16))
GAINS = 7


@dataclass(frozen=True)
class Sample:
    """Bounds of learning: documents of each class for the dictionaries and again for the calibration, bytes read of a
    document, strings that come back to the driver, and the sizes of the parts of a dictionary. Both parts together stay
    below the compression window of 16 KiB; `own_bytes` holds some 500 strings, all that reach `least_score` in practice."""

    documents: int = 2500
    text_bytes: int = 1 << 16
    strings: int = 20_000
    own_bytes: int = 8192
    common_bytes: int = 1500
    least_documents: int = 8
    least_score: float = 6.0


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...]
    centre: tuple[float, ...]
    scale: tuple[float, ...]


def _strings(text: bytes) -> set[bytes]:
    """Beginnings of the words of a text, with the blank before them, and whole words with both."""
    found = set()
    for word in set(text.lower().split()):
        word = word.strip(b".,;:!?")
        if len(word) < 3:
            continue
        found.update(b" " + word[:k] for k in range(3, min(len(word), 14) + 1))
        found.add(b" " + word[:24] + b" ")
    return found


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = (Counter(), Counter())
        for label, text in zip(batch.column("label").to_pylist(), texts(batch, "text"), strict=True):
            counts[label].update(_strings(text))
        names = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.binary()), *[pa.array([c[n] for n in names], pa.int64()) for c in counts]], names=["string", "ordinary", "toxic"])


def _compressors(toxic: bytes, ordinary: bytes):
    import zstandard as z

    shape = z.ZstdCompressionParameters(
        window_log=14, hash_log=12, chain_log=12, search_log=3, min_match=4, target_length=24, strategy=z.STRATEGY_GREEDY,
        format=z.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False)
    return [z.ZstdCompressor(dict_data=z.ZstdCompressionDict(d, dict_type=z.DICT_TYPE_RAWCONTENT), compression_params=shape).compress for d in (toxic, ordinary)]


def gains(text: bytes, toxic, ordinary) -> list[np.ndarray]:
    """By how many bytes the toxic dictionary beats the ordinary one, for the windows of each size of the whole text."""
    padded = b" " + text.lower() + b" "
    found = []
    for size, overlap in WINDOWS:
        windows = [padded[i : i + size] for i in range(0, max(1, len(padded) - overlap), size - overlap)]
        found.append(np.array([len(ordinary(w)) - len(toxic(w)) for w in windows]))
    return found


def _features(both: list[np.ndarray]) -> list[float]:
    out: list[float] = []
    for gain in both:
        n = len(gain)
        over = np.array([(gain >= k).sum() for k in range(1, GAINS + 1)])
        out += [*np.log((over + 0.3) / (n + 1)), *np.log1p(over[2:]), min(float(gain.max()), 10.0), float(gain.mean()), float(np.log(n)), float((gain <= -2).mean())]
    return out


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights (the first is the offset) of a ridge logistic regression by Newton's steps, and the scaling; the classes weigh
    the same."""
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    each = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    a = np.c_[np.ones(len(x)), (x - centre) / scale]
    w = np.zeros(a.shape[1])
    penalty = ridge * np.eye(len(w))
    penalty[0, 0] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w -= np.linalg.solve((a * (each * p * (1 - p))[:, None]).T @ a + penalty, a.T @ (each * (p - y)) + penalty @ w)
    return w, centre, scale


def _chosen(strings: list[bytes], limit: int) -> list[bytes]:
    """The first strings that neither hold nor lie in one taken before, up to a size."""
    taken: list[bytes] = []
    size = 0
    for s in strings:
        if any(s in t or t in s for t in taken):
            continue
        if size + len(s) > limit:
            break
        taken.append(s)
        size += len(s)
    return taken


def _drawn(docs: DataFrame, labels: DataFrame, sample: Sample) -> DataFrame | None:
    """The sampled rows as a written table: label, text and whether they make the dictionaries; None without both classes.

    Ids are drawn from the labels alone, so that only the few drawn ones meet the texts.
    """
    usable = labels.filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("label").cast("int").alias("label"))
    sizes = {r["label"]: r["n"] for r in usable.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows at most
    if set(sizes) != {0, 1}:
        return None
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("label") == 1, min(0.5, sample.documents / sizes[1])).otherwise(min(0.5, sample.documents / sizes[0]))
    ids = usable.select("doc_id", "label", (place < 0.5).alias("making"), place.alias("place"), share.alias("share"))
    ids = ids.filter(F.when(F.col("making"), F.col("place")).otherwise(F.col("place") - 0.5) < F.col("share")).select("doc_id", "label", "making").distinct()
    spare = F.greatest(F.length("text") - sample.text_bytes, F.lit(0))
    stretch = F.substring("text", (F.pmod(F.xxhash64("text"), spare + 1) + 1).cast("int"), F.lit(sample.text_bytes))
    bodies = docs.filter("text IS NOT NULL").select("doc_id", "text")
    found = bodies.join(F.broadcast(ids), "doc_id").select("doc_id", "label", "making", F.xxhash64("text").alias("place"), stretch.alias("text"))
    # about 4 x sample.documents ids, a text of each
    one = found.groupBy("doc_id", "label").agg(F.min(F.struct("place", "text", "making")).alias("first"))
    return written(one.select("label", "first.making", "first.text"), "op8-sample")


def fit(docs: DataFrame, labels: DataFrame, sample: Sample = Sample()) -> Model | None:
    """Learn from docs (doc_id, text) and labels (doc_id, label 0 or 1); None without both classes."""
    drawn = _drawn(docs, labels, sample)
    if drawn is None:
        return None
    making = drawn.filter("making").select("label", "text")
    calibrating = drawn.filter("NOT making").select("label", "text")

    shown = {r["label"]: r["n"] for r in making.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n1, n0 = max(1, shown.get(1, 0)), max(1, shown.get(0, 0))
    counts = making.mapInArrow(_count, "string binary, ordinary bigint, toxic bigint").groupBy("string").agg(F.sum("ordinary").alias("a"), F.sum("toxic").alias("b"))
    pooled = (F.col("a") + F.col("b")) / float(n0 + n1)
    score = (F.col("b") / n1 - F.col("a") / n0) / F.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n0) + 1e-9)
    scored = counts.filter(F.col("a") + F.col("b") >= sample.least_documents).select("string", F.col("a").alias("n"), F.round(score, 9).alias("z"))
    scored = written(scored, "op8-strings")

    def first(order: Column, rows: DataFrame) -> list[bytes]:
        top = rows.orderBy(order, F.desc(F.octet_length("string")), "string").limit(sample.strings).collect()  # bounded by the sample
        return [bytes(r["string"]) for r in top]

    own = b"".join(reversed(_chosen(first(F.desc("z"), scored.filter(F.col("z") >= sample.least_score)), sample.own_bytes)))
    common = b"".join(reversed(_chosen(first(F.desc("n"), scored.filter(F.abs("z") < sample.least_score)), sample.common_bytes))).rjust(64)
    toxic, ordinary = own.rjust(64) + common, b"".rjust(max(64, len(own))) + common

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = _compressors(toxic, ordinary)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array([_features(gains(t, *both)) for t in texts(batch, "text")], pa.list_(pa.float64()))], names=["label", "x"])

    seen = calibrating.repartition(docs.sparkSession.sparkContext.defaultParallelism).mapInArrow(measure, "label int, x array<double>").toPandas()  # bounded by the sample
    if seen["label"].nunique() < 2:
        return None
    x, y = np.array(seen["x"].tolist()), seen["label"].to_numpy(float)
    order = np.lexsort((*x.T, y))  # rows come in any order; sums are made in one
    weights, centre, scale = _logistic(x[order], y[order])
    return Model(toxic, ordinary, tuple(weights), tuple(centre), tuple(scale))


def toxicity(text: Column, model: Model | None) -> Column:
    """The score of a text, 0 to 1."""
    if model is None:
        return F.lit(0.0)

    @F.arrow_udf(T.DoubleType())
    def score(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        both = _compressors(model.toxic, model.ordinary)
        weights, centre, scale = map(np.array, (model.weights, model.centre, model.scale))
        for values in columns:
            if not len(values):
                yield pa.array([], pa.float64())
                continue
            x = np.array([_features(gains(v.as_py() or b"", *both)) for v in values.cast(pa.large_binary())])
            yield pa.array(1 / (1 + np.exp(-np.clip(np.c_[np.ones(len(x)), (x - centre) / scale] @ weights, -30, 30))))

    return score(text)
