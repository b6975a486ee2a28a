"""Embeddings and vector top-k (S-01..S-08)."""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from termweave.operators import vector_index as I
from termweave.operators.lexical import CODE_SOURCE, INDEX_SOURCE, POOL

Encoder = Callable[[list[str]], "list[list[float]] | np.ndarray"]
BATCH = 64
INNER_BLOCK = 256
STREAM_BLOCK = 4096
QUERY_BLOCKS = 4


def embedding_text(concepts: DataFrame, synonyms: DataFrame) -> DataFrame:
    """S-01: the display, or `display. Includes: a; b` with sorted synonyms that add something."""
    names = synonyms.groupBy("concept_id").agg(F.sort_array(F.collect_set("synonym")).alias("names"))
    useful = F.filter(
        F.coalesce("names", F.array().cast("array<string>")),
        lambda s: (F.length(s) > 0) & (F.lower(s) != F.lower(F.col("display"))),
    )
    return (
        concepts.join(names, "concept_id", "left")
        .withColumn("useful", useful)
        .withColumn(
            "text",
            F.when(F.size("useful") > 0, F.concat("display", F.lit(". Includes: "), F.array_join("useful", "; ")))
            .otherwise(F.col("display")),
        )
        .drop("names", "useful")
    )


def pending_rows(
    rows: DataFrame, embeddings: DataFrame, model: str, order: list[str], limit: int | None = None
) -> DataFrame:
    """S-02: rows without a vector of `model`; with `limit`, the caller's trial size, the first ones by `order`."""
    done = embeddings.where(F.col("model") == model).select("source", "row_id")
    todo = rows.join(done, ["source", "row_id"], "left_anti")
    return todo if limit is None else todo.orderBy(*order).limit(limit)


def done_count(rows: DataFrame, embeddings: DataFrame, model: str) -> DataFrame:
    done = embeddings.where(F.col("model") == model).select("source", "row_id").distinct()
    return rows.join(done, ["source", "row_id"], "left_semi").groupBy("source").agg(F.count(F.lit(1)).alias("done"))


def query_instruction(queries: DataFrame, instruction: str) -> DataFrame:
    """S-04: queries (and only queries) get the retrieval instruction in front."""
    return queries.withColumn("text", F.concat(F.lit(instruction), F.col("query")))


def hashing_encoder(dimensions: int = 64) -> Callable[[], Encoder]:
    """A small deterministic encoder for tests: signed hashed trigrams, unit length."""

    def build() -> Encoder:
        def encode(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dimensions), dtype=np.float64)
            for row, text in enumerate(texts):
                for word in text.lower().split():
                    padded = f"  {word} "
                    for i in range(len(padded) - 2):
                        code = zlib.crc32(padded[i : i + 3].encode("utf-8"))
                        out[row, code % dimensions] += 1.0 if code & 0x80000000 else -1.0
            norms = np.linalg.norm(out, axis=1, keepdims=True)
            return (out / np.where(norms == 0, 1.0, norms)).astype(np.float32)

        return encode

    return build


def embed_batches(
    pending: DataFrame, model: str, encoder_factory: Callable[[], Encoder], dimensions: int, batch: int = BATCH, isolate: bool = False
) -> DataFrame:
    """S-03: (source, row_id, model, embedding); the encoder is built once per task.

    Raises when the encoder fails or returns another number of vectors or another dimension (S-05). With `isolate` the
    texts of such a batch are encoded one by one, and one that fails by itself has no vector but an `error`.
    """
    schema = T.StructType(
        [
            T.StructField("source", pending.schema["source"].dataType),
            T.StructField("row_id", pending.schema["row_id"].dataType),
            T.StructField("model", T.StringType()),
            T.StructField("embedding", T.ArrayType(T.FloatType())),
            *[T.StructField("error", T.StringType())] * isolate,
        ]
    )

    def vectors_of(encoder: Encoder, texts: list[str]) -> list[np.ndarray]:
        vectors = [np.asarray(v, dtype=np.float32) for v in encoder(texts)]
        if len(vectors) != len(texts):
            raise ValueError(f"encoder returned {len(vectors)} vectors for {len(texts)} texts")
        if any(len(v) != dimensions for v in vectors):
            raise ValueError(f"encoder vectors are not of dimension {dimensions}")
        return vectors

    def one_by_one(encoder: Encoder, texts: list[str]) -> tuple[list[np.ndarray | None], list[str | None]]:
        vectors: list[np.ndarray | None] = []
        errors: list[str | None] = []
        for text in texts:
            try:
                vectors += vectors_of(encoder, [text])
                errors.append(None)
            except Exception as exc:  # one bad text must not sink the batch
                vectors.append(None)
                errors.append(f"{type(exc).__name__}: {exc}"[:500])
        return vectors, errors

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = encoder_factory()
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                texts, errors = part["text"].tolist(), [None] * len(part)
                try:
                    vectors = vectors_of(encoder, texts)
                except Exception:
                    if not isolate:
                        raise
                    vectors, errors = one_by_one(encoder, texts)
                out = {"source": part["source"], "row_id": part["row_id"], "model": model, "embedding": pd.Series(vectors, index=part.index, dtype=object)}
                yield pd.DataFrame(out | ({"error": pd.Series(errors, index=part.index, dtype=object)} if isolate else {}))

    return pending.select("source", "row_id", "text").mapInPandas(encode, schema)


def check_vectors(inputs: DataFrame, vectors: DataFrame, dimensions: int) -> DataFrame:
    """S-05: violations (source, row_id, problem): missing, unasked or of another dimension."""
    asked = inputs.select("source", "row_id", F.lit(True).alias("asked"))
    got = vectors.select("source", "row_id", F.size("embedding").alias("n"))
    problem = (
        F.when(F.col("n").isNull(), F.lit("missing"))
        .when(F.col("asked").isNull(), F.lit("not asked for"))
        .when(F.col("n") != dimensions, F.lit("wrong dimension"))
    )
    return (
        asked.join(got, ["source", "row_id"], "full_outer")
        .select("source", "row_id", problem.alias("problem"))
        .where("problem is not null")
    )


def _packed(ids: list[str], size: int) -> Callable:
    """Rows with `embedding` as blocks of at most `size`: `at`, each of `ids` as an array, the vectors as bytes and their dimension."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 40
        for batch in batches:
            for low in range(0, batch.num_rows, size):
                part = batch.slice(low, size)
                vectors = part["embedding"]
                values = vectors.flatten().to_numpy(zero_copy_only=False)
                dimension = len(values) // len(part)
                if vectors.null_count or pc.any(pc.not_equal(pc.list_value_length(vectors), dimension)).as_py():
                    raise ValueError("a vector is missing or of another dimension")
                columns = [pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part[c]) for c in ids]
                columns = [pa.array([at]), *columns, pa.array([values.tobytes()]), pa.array([dimension], pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["at", *ids, "vectors", "dimension"])
                at += 1

    return pack


def _pack(df: DataFrame, ids: list[str], size: int, prefix: str) -> DataFrame:
    fields = [T.StructField(c, T.ArrayType(df.schema[c].dataType)) for c in ids]
    schema = T.StructType([T.StructField("at", T.LongType()), *fields, T.StructField("vectors", T.BinaryType()), T.StructField("dimension", T.IntegerType())])
    blocks = df.select(*ids, "embedding").mapInArrow(_packed(ids, size), schema)
    return blocks.select(*[F.col(c).alias(f"{prefix}_{c}") for c in blocks.columns])


def _unit_block(vectors: bytes, rows: int, dimension: int) -> np.ndarray:
    kind = np.float32 if len(vectors) == 4 * rows * dimension else np.float64
    m = np.frombuffer(vectors, dtype=kind).astype(np.float64).reshape(rows, dimension)
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norms == 0, 1.0, norms)


def _plain(values: pa.Array) -> np.ndarray:
    if pa.types.is_integer(values.type) and not values.null_count:
        return values.to_numpy()
    out = np.empty(len(values), dtype=object)
    out[:] = values.to_pylist()
    return out


def _in_order(values: np.ndarray) -> np.ndarray:
    """Numbers in the order of the values, those without one last."""
    if values.dtype != object:
        return values
    codes, known = pd.factorize(values, sort=True)
    return np.where(codes < 0, len(known), codes)


class _BestRows:
    """The best `k` corpus rows so far of a few queries, by (score, sort_key, row_id)."""

    def __init__(self, unit: np.ndarray, k: int):
        self.unit, self.k = unit, k
        self.edge = np.full(len(unit), -np.inf)  # no score below it is among the best
        self.found: list[tuple] = []
        self.waiting = 0

    def offer(self, right: np.ndarray, keys: np.ndarray, ids: np.ndarray) -> None:
        scores = self.unit @ right
        edge = self.edge
        if scores.shape[1] > self.k and np.isinf(edge).any():
            edge = np.maximum(edge, np.partition(scores, -self.k, axis=1)[:, -self.k])
        # Scores are compared as rounded to 9 digits; the rest decides exactly.
        row, column = np.nonzero(~(scores < (edge - 2e-9)[:, None]))
        if len(row):
            self.found.append((row, np.round(scores[row, column], 9), keys[column], ids[column]))
            self.waiting += len(row)
            if self.waiting > 2 * self.k * len(self.unit):
                self.settle()

    def settle(self) -> None:
        row, score, key, name = (np.concatenate([f[i] for f in self.found]) for i in range(4))
        order = np.lexsort((_in_order(name), _in_order(key), -score, row))
        first = np.searchsorted(row[order], np.arange(len(self.unit)))
        kept = order[np.arange(len(order)) - first[row[order]] < self.k]
        row, score, key, name = (values[kept] for values in (row, score, key, name))
        self.found = [(row, score, key, name)]
        full = np.bincount(row, minlength=len(self.unit)) >= self.k
        last = np.searchsorted(row, np.arange(len(self.unit)), side="right") - 1
        self.edge = np.where(full, score[last] if len(score) else -np.inf, -np.inf)
        self.waiting = 0


def _stream_topk(k: int, types: dict[str, T.DataType]) -> Callable:
    """Pairs of packed blocks -> the best `k` corpus rows of each query among the corpus blocks that the task sees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: dict[int, tuple] = {}
        at, corpus = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                cell = {c: batch[c][i] for c in batch.schema.names}
                if cell["c_at"].as_py() != at:
                    at, ids = cell["c_at"].as_py(), _plain(cell["c_row_id"].values)
                    unit = _unit_block(cell["c_vectors"].as_py(), len(ids), cell["c_dimension"].as_py())
                    corpus = (unit.T, _plain(cell["c_sort_key"].values), ids)
                block = cell["q_at"].as_py()
                if block not in asked:
                    names = cell["q_query_id"].values
                    unit = _unit_block(cell["q_vectors"].as_py(), len(names), cell["q_dimension"].as_py())
                    asked[block] = (pa.array(names.to_pylist(), names.type), [_BestRows(unit[low : low + INNER_BLOCK], k) for low in range(0, len(unit), INNER_BLOCK)])
                for best in asked[block][1]:
                    best.offer(*corpus)
        for names, parts in asked.values():
            for number, best in enumerate(parts):
                if best.found:
                    best.settle()
                    row, score, key, name = best.found[0]
                    columns = [names.take(pa.array(row + number * INNER_BLOCK)), pa.array(name, types["row_id"]), pa.array(key, types["sort_key"]), pa.array(score)]
                    yield pa.RecordBatch.from_arrays(columns, ["query_id", "row_id", "sort_key", "score"])

    return run


def _keep_best(found: DataFrame, k: int, by: list[str]) -> DataFrame:
    order = W.partitionBy(*by).orderBy(F.desc("score"), "sort_key", "row_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _cell_schema(queries: DataFrame, corpus: DataFrame) -> T.StructType:
    return T.StructType(
        [
            T.StructField("query_id", queries.schema["query_id"].dataType),
            T.StructField("row_id", corpus.schema["row_id"].dataType),
            T.StructField("sort_key", corpus.schema["sort_key"].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )


def knn_topk(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = POOL,
    query_block: int = I.QUERY_BLOCK,
    corpus_block: int = I.CORPUS_BLOCK,
) -> DataFrame:
    """S-06: exact top `k` by cosine: (query_id, row_id, sort_key, score, rank).

    Both sides are dealt out once and packed into blocks of bounded size. A task holds the best `k` rows of at most
    `QUERY_BLOCKS` query blocks and streams the corpus blocks of one share past them, a matrix product a pair of blocks, so its
    memory does not grow with the data. The corpus has no more shares than tasks need to be busy, and one where the queries
    are many: only `k` rows per query and share leave a task. The two row counts set the numbers of tasks.
    """
    asked, stored = queries.count(), corpus.count()
    places = math.ceil(asked / (query_block * QUERY_BLOCKS)) or 1
    busy = 2 * queries.sparkSession.sparkContext.defaultParallelism
    shares = min(math.ceil(busy / places), math.ceil(stored / corpus_block) or 1)
    left = _pack(corpus.repartition(shares, "row_id"), ["row_id", "sort_key"], min(corpus_block, STREAM_BLOCK), "c")
    right = _pack(queries.repartition(places, "query_id"), ["query_id"], query_block, "q")
    cells = left.crossJoin(right.hint("shuffle_replicate_nl"))
    schema = _cell_schema(queries, corpus)
    types = {f.name: f.type for f in to_arrow_schema(schema)}
    return _keep_best(cells.mapInArrow(_stream_topk(k, types), schema), k, ["query_id"])


@dataclass(frozen=True)
class AnnSearch:
    """An index with what a search of it needs: lists to probe, rows to score by their own vectors."""

    index: I.VectorIndex
    probes: int
    refine: int


def ann_prepare(
    queries: DataFrame, corpus: DataFrame, k: int = POOL, lists: int | None = None, probes: int | None = None, recall: float = 0.95
) -> AnnSearch | None:
    """Build the index of `corpus`; probes, if not given, and exact scores follow from `recall` for a sample of the queries."""
    index = I.build_index(corpus, lists)
    if index is None:
        return None
    some = queries.where("embedding is not null").select("query_id", "embedding")
    some = some.orderBy(F.xxhash64("query_id"), "query_id").limit(I.ASKED).collect()
    if not some:
        return AnnSearch(index, probes or 1, I.REFINE * k)
    found, refine = I.probes_for(index, I.unit_rows(pd.Series([r["embedding"] for r in some])), k, recall)
    return AnnSearch(index, probes or found, refine)


def ann_topk(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = POOL,
    lists: int | None = None,
    probes: int | None = None,
    query_block: int = I.QUERY_BLOCK,
    corpus_block: int = I.CORPUS_BLOCK,
    recall: float = 0.95,
    prepared: AnnSearch | None = None,
) -> DataFrame:
    """S-07: approximate top `k`: (query_id, row_id, sort_key, score, rank), by an inverted file over quantised rows.

    See `vector_index`. Filters belong on `corpus` before the call, so no result is lost to them. The lists of a
    coarse pivot with many vectors are split into cells of `corpus_block`, and those that many queries
    probe into cells of `query_block`. `prepared` is a search of the same corpus, to use it more than once.
    """
    prepared = prepared or ann_prepare(queries, corpus, k, lists, probes, recall)
    if prepared is None:
        return knn_topk(queries, corpus, k, query_block, corpus_block)
    refine = prepared.refine
    asked = I.probed(prepared.index, queries, prepared.probes)
    cells = I.cells(asked, prepared.index.rows, query_block, corpus_block)
    scanned = cells.applyInPandas(I.scan(prepared.index.quantiser, refine), _cell_schema(queries, corpus))
    short = _keep_best(scanned, refine, ["query_id"]).select("query_id", "row_id", "sort_key").distinct()
    stored = corpus.where("embedding is not null").select("row_id", "sort_key", F.col("embedding").alias("stored"))
    scored = (
        short.join(stored, ["row_id", "sort_key"])
        .join(queries.select("query_id", F.col("embedding").alias("asked")), "query_id")
        .select("query_id", "row_id", "sort_key", I.exact_cosine("asked", "stored").alias("score"))
    )
    return _keep_best(scored, k, ["query_id"])


def ann_recall(exact: DataFrame, approximate: DataFrame) -> DataFrame:
    """Share of the exact neighbours that the approximate search returned."""
    hit = approximate.select("query_id", "row_id", F.lit(1).alias("hit"))
    return exact.join(hit, ["query_id", "row_id"], "left").agg(
        F.count(F.lit(1)).alias("neighbours"), F.count("hit").alias("found"),
        (F.count("hit") / F.count(F.lit(1))).alias("recall"),
    )


def semantic_candidates(
    queries: DataFrame,
    vectors: DataFrame,
    pool: int = POOL,
    include_index_terms: bool = True,
    topk: Callable[..., DataFrame] = knn_topk,
) -> DataFrame:
    """S-08: the best `pool` rows per query from codes and, unless switched off, from index terms.

    `vectors`: source, row_id, concept_id, sort_key, sort_text, embedding (one model, one release).
    """
    out = None
    for source in (CODE_SOURCE, INDEX_SOURCE)[: 2 if include_index_terms else 1]:
        some = vectors.where(F.col("source") == source)
        best = topk(queries, some, pool).select("query_id", "row_id", "score", F.col("rank").alias("source_rank"))
        found = best.join(some.select("row_id", "concept_id", "sort_text"), "row_id").select(
            "query_id", "concept_id", "score",
            (F.col("sort_text") if source == INDEX_SOURCE else F.lit(None).cast("string")).alias("matched_on"),
            F.lit(source).alias("source"), "source_rank",
        )
        out = found if out is None else out.unionByName(found)
    return out
