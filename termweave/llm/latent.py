"""Benchmark decontamination: passages near an item in a latent space, then longest common subsequence and answer checks.

1. Every document is read once as ids of the items' words; documents with equal ids are counted, fitted and judged once.
   Document frequencies of the words over all documents give the TF-IDF weights.
2. A randomised SVD of TF-IDF passages: Spark sums A'(A R) for a random R over the passages of all different documents and all
   items; its orthonormal basis, turned by the small matrix of the second pass, holds the leading right singular vectors.
3. Every document is read in windows; window vectors are differences of running sums of word vectors. Wide windows, one every
   twelve words, whose cosine with an item reaches `coarse` are read again in finer ones, 12 to 48 words wide and one every four
   words; a fine window whose cosine reaches `cosine` is a candidate.
4. A candidate is a leak if a stretch of `stretch` times the item's size around it holds the item's words in order: `verbatim` of
   them, or `paraphrase` of them with `answer` of the item's answer (its last sentence, or last quarter where it has only one).
5. Items below `least_words` words have no direction of their own and are found by their rarest words: all their words must
   follow each other. Items below `least_exact` words would meet by chance: only a text that is the item leaks it.

Items are taken in blocks bounded by items and by different words, `blocks` of them at a time (a stated query set against all
rows). Each such round writes the documents' ids, and reads them once for frequencies, twice a block for the fit and once for the
search (`clean` reads the texts again there).
The driver holds the vectors of a block's words and never a matrix of items by words.

Defined results: words are lower-cased runs without punctuation; in scripts without blanks every character is a word. Null and
empty texts leak nothing; items without words are no items; a row is judged by itself, so repeated rows, null ids and
extra columns need no care; of equal items each is reported.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termweave.llm.common import discard, texts, written
from termweave.session import width as width_of

_LETTERS = bytes(b if chr(b).isalnum() or b >= 128 else 32 for b in range(256))
#: Scripts written without blanks (Thai to Tibetan, Myanmar, Khmer, kana, Han), and punctuation beyond ASCII.
_UNSPACED = re.compile("([\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff])")
_MARKS = re.compile("[\u2010-\u206f\u3000-\u303f\uff00-\uff0f\uff1a-\uff20]+")
_SEGMENT = 12 << 10
_POSTED = 2 << 10
_PAIRS = 2048
_GATHERED = 8 << 10


@dataclass(frozen=True)
class Options:
    rank: int = 96
    extra: int = 16
    sample_documents: int = 2000
    sample_bytes: int = 1 << 16
    step: int = 4
    widths: tuple[int, ...] = (12, 16, 24, 48)
    coarse_step: int = 12
    coarse_widths: tuple[int, ...] = (24, 48)
    levelling: float = 1.5
    coarse: float = 0.5
    cosine: float = 0.6
    verbatim: float = 0.7
    paraphrase: float = 0.55
    answer: float = 0.75
    stretch: float = 1.5
    least_words: int = 8
    least_exact: int = 4
    block: int = 2000
    block_words: int = 32_768
    blocks: int = 4
    seed: int = 5


@dataclass(frozen=True)
class Space:
    """What a task needs for one block of items."""

    words: tuple[bytes, ...]
    vectors: np.ndarray  # IDF times the leading singular vectors, per word
    item_ids: tuple[int, ...]
    items: tuple[tuple[int, ...], ...]
    answers: tuple[int, ...]  # how many last words are the answer
    item_vectors: np.ndarray  # 0 for items below least_words
    weights: np.ndarray  # IDF per word


def words_of(text: bytes) -> list[bytes]:
    if text.isascii():
        return text.lower().translate(_LETTERS).split()
    spaced = _UNSPACED.sub(r" \1 ", _MARKS.sub(" ", text.decode("utf-8", "replace").lower()))
    return spaced.encode().translate(_LETTERS).split()


def _answer_size(text: str) -> int:
    sentences = [s for s in re.split(r"(?<=[.!?:])\s+", text.strip()) if words_of(s.encode())]
    size = len(words_of(text.encode()))
    last = len(words_of(sentences[-1].encode())) if len(sentences) > 1 else 0
    return last if 3 <= last <= size // 2 else max(1, size // 4)


def _ids(index: dict[bytes, int], text: bytes) -> np.ndarray:
    """Word ids; words that no item has share the last one, whose vector is 0."""
    return np.array(list(map(index.get, words_of(text), repeat(len(index)))), np.int32)


def _kind(words: tuple[bytes, ...]) -> type:
    """The smallest type for ids of some words and the id of all others."""
    return np.uint16 if len(words) < 1 << 16 else np.uint32


def _read(docs: DataFrame, text: str, words: tuple[bytes, ...]) -> DataFrame:
    """The documents with `ids`, the ids of a text's words as bytes, and `digest`, equal for equal ids; in place of the text."""

    @F.arrow_udf(T.BinaryType())
    def ids(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index, kind = {w: i for i, w in enumerate(words)}, _kind(words)
        for values in columns:
            yield pa.array([_ids(index, v.as_py() or b"").astype(kind).tobytes() for v in values.cast(pa.large_binary())], pa.binary())

    return docs.withColumn("ids", ids(F.col(text))).drop(text).withColumn("digest", F.md5("ids"))


def _different(read: DataFrame) -> DataFrame:
    """Each different sequence of ids with `n`, the documents that have it."""
    return read.groupBy("digest").agg(F.first("ids").alias("ids"), F.count(F.lit(1)).alias("n"))


def _frequencies(different: DataFrame, words: tuple[bytes, ...]) -> tuple[np.ndarray, int]:
    """Documents that hold each word, and all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(words) + 2, np.int64)
        for batch in batches:
            for value, n in zip(texts(batch, "ids"), batch.column("n").to_pylist(), strict=True):
                total[-1] += n
                total[np.unique(np.frombuffer(value, _kind(words)))] += n
        yield pa.record_batch({"word": np.arange(len(total)), "n": total})

    rows = different.select("ids", "n").mapInArrow(count, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")).toArrow()  # one per word
    total = np.zeros(len(words) + 2, np.int64)
    total[rows.column("word").to_numpy()] = rows.column("n").to_numpy()
    return total[:-2], int(total[-1])


def _places(words: tuple[bytes, ...], block: tuple[bytes, ...]) -> np.ndarray:
    """The ids in a block of the ids of some words; words that the block has not share its last one."""
    index = {w: i for i, w in enumerate(block)}
    return np.array([*(index.get(w, len(block)) for w in words), len(block)], np.int32)


def _range_product(different: DataFrame, places: np.ndarray, kind: type, weights: np.ndarray, right: np.ndarray, width: int) -> np.ndarray:
    """A'(A right) over the passages of all different documents, summed by Spark; one row per word comes back, as an array."""
    size, columns = right.shape
    right = (weights[:, None] * right).astype(np.float32)

    def rows(total: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        flat = pa.array(total[at].ravel(), pa.float64())
        return pa.record_batch({"i": pa.array(at, pa.int64()), "x": pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * columns, pa.int32()), flat)})

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, columns))
        held: list[np.ndarray] = []
        passages = 0

        def add() -> None:
            """Adds the passages of the held documents: their sums of word vectors, to each of their words."""
            ids = places[np.concatenate(held)]
            passage = np.concatenate([np.arange(len(h)) // width for h in held])
            passage += np.repeat(np.cumsum([0, *(-(-len(h) // width) for h in held[:-1])]), [len(h) for h in held])
            at = np.flatnonzero(ids < size)
            ids, passage = ids[at], passage[at]
            for low in range(0, len(ids), _GATHERED):
                # whole passages only: a cut falls where the next passage begins
                a, b = (int(np.searchsorted(passage, passage[c])) if c < len(ids) else len(ids) for c in (low, low + _GATHERED))
                if a == b:
                    continue
                own, mine = ids[a:b], passage[a:b]
                first = np.flatnonzero(np.diff(mine, prepend=-1))
                sums = np.add.reduceat(right.take(own, axis=0), first, axis=0)
                mine = np.cumsum(np.diff(mine, prepend=mine[0]) > 0)
                order = np.argsort(own, kind="stable")
                word, begin = np.unique(own[order], return_index=True)
                total[word] += np.add.reduceat(sums.take(mine[order], axis=0), begin, axis=0)

        for batch in batches:
            for value in texts(batch, "ids"):
                if not value:
                    continue
                held.append(np.frombuffer(value, kind))
                passages += len(held[-1])
                if passages >= _SEGMENT:
                    add()
                    held, passages = [], 0
        if held:
            add()
        yield rows(total, np.flatnonzero(total.any(axis=1)))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, columns))
        for batch in batches:
            np.add.at(total, batch.column("i").to_numpy(), batch.column("x").flatten().to_numpy().reshape(-1, columns))
        yield rows(total, np.flatnonzero(total.any(axis=1)))

    result = "i bigint, x array<double>"
    # a bounded number of partial sums, each of up to a row per word, however many documents there are
    bounded = different.select("ids").coalesce(width_of(different.sparkSession))
    parts = bounded.mapInArrow(partial, result).repartition(4, "i").mapInArrow(summed, result).toArrow()
    product = np.zeros((size, columns))
    for batch in parts.to_batches():
        product[batch.column("i").to_numpy()] = batch.column("x").flatten().to_numpy().reshape(-1, columns)
    return weights[:, None] * product


def sampled(docs: DataFrame, text: str, options: Options) -> DataFrame:
    """About `sample_documents` different texts by hash, each once, however often a text repeats.

    For a look at a corpus only: the search is fitted to all documents.
    """
    usable = docs.select(text).filter(F.col(text).isNotNull() & (F.octet_length(text) <= options.sample_bytes))
    different = usable.agg(F.approx_count_distinct(F.xxhash64(text)).alias("n")).first()["n"]
    share = min(1.0, options.sample_documents / max(1, different))
    return usable.filter(F.pmod(F.xxhash64(text), F.lit(1 << 30)) < int(share * (1 << 30))).distinct()


@dataclass(frozen=True)
class _Items:
    """The items of a block: ids, texts, and their word ids one after the other (no matrix of items by words)."""

    words: tuple[bytes, ...]
    ids: tuple[int, ...]
    rows: tuple[tuple[int, ...], ...]
    answers: tuple[int, ...]

    def product(self, weighted: np.ndarray, rows: range) -> np.ndarray:
        """Sums of the weighted word vectors of some items."""
        return np.array([weighted[list(self.rows[r])].sum(axis=0) for r in rows])


def _items(block: list[tuple[int, str]]) -> _Items:
    split = [(i, words_of(t.encode()), t) for i, t in block]
    split = [x for x in split if x[1]]
    words = tuple(sorted({w for _, ws, _ in split for w in ws}))
    index = {w: k for k, w in enumerate(words)}
    return _Items(words, tuple(i for i, _, _ in split), tuple(tuple(index[w] for w in ws) for _, ws, _ in split), tuple(_answer_size(t) for _, _, t in split))


def fit(different: DataFrame, known: tuple[bytes, ...], items: _Items, held: np.ndarray, n: int, options: Options = Options()) -> Space:
    """The latent space of one block of items; `held` of `n` documents hold each of its words.

    `different` has each different document as ids of the `known` words.
    """
    words, chunk = items.words, 256
    places = _places(known, words)
    weights = np.log((n + 1.0) / (held + 1.0)) + 0.05
    # no more directions than items: the rest would be the corpus alone, and levelling would make it count
    rank = min(options.rank, len(words), max(1, sum(len(r) >= options.least_words for r in items.rows)))
    right = np.random.default_rng(options.seed).standard_normal((len(words), min(len(words), rank + options.extra)))
    chunks = [range(a, min(a + chunk, len(items.rows))) for a in range(0, len(items.rows), chunk)]
    for _ in range(2):
        corpus = _range_product(different, places, _kind(known), weights, right, options.coarse_widths[-1])
        weighted, mine = weights[:, None] * right, np.zeros_like(right)
        for rows in chunks:
            own = items.product(weighted, rows)
            np.add.at(mine, np.concatenate([items.rows[r] for r in rows]), np.repeat(own, [len(items.rows[r]) for r in rows], axis=0))
        mine *= weights[:, None]
        # Items and corpus weigh the same, whatever their sizes.
        product = mine / (np.linalg.norm(mine) + 1e-12) + corpus / (np.linalg.norm(corpus) + 1e-12)
        # Orthonormal columns from the small Gram matrix, twice for accuracy.
        basis = product
        for _ in range(2):
            values, turn = np.linalg.eigh(basis.T @ basis)
            keep = values > values[-1] * 1e-12
            basis = basis @ (turn[:, keep] / np.sqrt(values[keep]))
        last, right = right, basis
    # The second product is (A'A) applied to the first basis: its small eigenproblem turns it into singular vectors.
    small = last.T @ product
    values, turn = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(values)[::-1][:rank]
    # Divided by a power of their singular values: else the few directions all texts of a language share decide.
    strength = np.sqrt(np.maximum(values[order], values[order[0]] * 1e-9)) ** options.levelling
    leading = weights[:, None] * (last @ turn[:, order]) / strength
    latent = np.vstack([items.product(leading, rows) for rows in chunks]).astype(np.float32)
    latent /= np.linalg.norm(latent, axis=1, keepdims=True) + 1e-9
    latent[[len(r) < options.least_words for r in items.rows]] = 0
    return Space(words, np.vstack([leading, np.zeros((1, leading.shape[1]))]).astype(np.float32), items.ids, items.rows, items.answers, latent, weights)


def common_subsequence(masks: dict[int, int], size: int, ids: list[int]) -> int:
    """Bits of an item's words in the longest common subsequence with `ids` (bit-parallel); a set of places as an int."""
    full = (1 << size) - 1
    row = full
    for w in ids:
        m = masks.get(w)
        if m:
            hit = row & m
            row = ((row + hit) | (row - hit)) & full
    return full & ~row


class Matcher:
    def __init__(self, space: Space, options: Options):
        self.space, self.options = space, options
        self.index = {w: i for i, w in enumerate(space.words)}
        self.masks = []
        for item in space.items:
            masks: dict[int, int] = {}
            for place, w in enumerate(item):
                masks[w] = masks.get(w, 0) | 1 << place
            self.masks.append(masks)
        self.short = [i for i, item in enumerate(space.items) if len(item) < options.least_words]
        self.reach = np.array([len(i) if len(i) < options.least_words else math.ceil(options.stretch * len(i)) for i in space.items], np.int64)
        self.posted_for: list[int] | None = None

    def _need(self, item: int) -> int:
        size = len(self.space.items[item])
        return size if size < self.options.least_words else math.ceil(self.options.paraphrase * size - 1e-9)

    def _post(self, which: list[int]) -> None:
        """Some items by their rarest words, and how many of these a stretch that can be a leak holds at least."""
        if self.posted_for == which:
            return
        self.posted_for = which
        pairs: list[tuple[int, int]] = []
        self.least = np.zeros(len(self.space.items), np.int64)
        for i in which:
            masks, size, need = self.masks[i], len(self.space.items[i]), self._need(i)
            wanted, taken = size - need + max(1, -(-need // 3)), 0
            for w in sorted(masks, key=lambda w: (-self.space.weights[w], w)):
                if taken >= wanted:
                    break
                taken += masks[w].bit_count()
                pairs.append((w, i))
            self.least[i] = taken - (size - need)
        pairs.sort()
        self.posted = np.array([i for _, i in pairs], np.int64)
        self.counts = np.bincount(np.array([w for w, _ in pairs], np.int64), minlength=len(self.space.words) + 1)
        self.ends = np.cumsum(self.counts)

    def stretches(self, ids: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, begin, end): runs of words that hold every stretch with enough of the item's rarest words."""
        for begin in range(0, max(1, len(ids)), _POSTED):
            part = ids[begin : begin + _POSTED + int(self.reach.max())]
            many = self.counts[part]
            total = int(many.sum())
            if not total:
                continue
            place = np.repeat(np.arange(len(part)), many)
            item = self.posted[np.arange(total) + np.repeat(self.ends[part] - np.cumsum(many), many)]
            order = np.argsort(item, kind="stable")
            item, place = item[order], place[order]
            last = np.arange(total) + self.least[item] - 1
            held = np.minimum(last, total - 1)
            first = np.flatnonzero((last < total) & (item[held] == item) & (place[held] - place < self.reach[item]))
            run: tuple[int, int, int] | None = None
            for i, a, b in zip(item[first].tolist(), place[first].tolist(), place[held[first]].tolist(), strict=True):
                reach = int(self.reach[i])
                low, high = max(0, begin + b - reach + 1), min(len(ids), begin + a + reach)
                if run and run[0] == i and low <= run[2]:
                    run = (i, run[1], max(run[2], high))
                    continue
                if run:
                    yield run
                run = (i, low, high)
            if run:
                yield run

    def _common(self, item: int, around: list[int]) -> int:
        """Item words that come in order in `around`, where they are enough for a leak; else 0."""
        size, answer = len(self.space.items[item]), self.space.answers[item]
        hit = common_subsequence(self.masks[item], size, around)
        common = hit.bit_count()
        if common < self._need(item):
            return 0
        if common < self.options.verbatim * size and (hit >> (size - answer)).bit_count() < self.options.answer * answer:
            return 0
        return common

    def _best(self, item: int, around: list[int]) -> int:
        """The most item words that come in order in one stretch of `around`, where they are enough for a leak; else 0."""
        reach = int(self.reach[item])
        most = common_subsequence(self.masks[item], len(self.space.items[item]), around).bit_count()
        best = 0
        for a in range(max(1, len(around) - reach + 1) if most >= self._need(item) else 0):
            best = max(best, self._common(item, around[a : a + reach]))
            if best == most:
                break
        return best

    def _cosine(self, item: int, ids: list[int]) -> float:
        total = self.space.vectors[ids].sum(axis=0)
        return float(total @ self.space.item_vectors[item] / (np.linalg.norm(total) + 1e-9))

    def by_words(self, ids: np.ndarray, which: list[int] | None = None) -> Iterator[tuple[int, int, float]]:
        """(item, common words, cosine) of each stretch that is a leak of one of some items, or of any."""
        which = list(range(len(self.space.items))) if which is None else which
        if not which:
            return
        self._post(which)
        for item, low, high in self.stretches(ids):
            masks, reach = self.masks[item], int(self.reach[item])
            size, need = len(self.space.items[item]), self._need(item)
            run = ids[low:high].tolist()
            for at in range(0, max(1, len(run) - reach + 1), reach):  # each stretch lies in one of these
                two = run[at : at + 2 * reach]
                if common_subsequence(masks, size, two).bit_count() < need:
                    continue
                for a in range(len(two)):
                    if common := self._common(item, two[a : a + reach]):
                        yield item, common, self._cosine(item, two[a : a + reach])

    def candidates(self, ids: np.ndarray) -> dict[tuple[int, int], tuple[float, int]]:
        """(item, start) with cosine and width: the best fine window of an item in each wide window near it."""
        found: dict[tuple[int, int], tuple[float, int]] = {}
        vectors, items, step = self.space.vectors, self.space.item_vectors, self.options.step
        fewest = math.ceil(self.options.paraphrase * self.options.least_words)
        for begin in range(0, max(1, len(ids)), _SEGMENT):
            part = ids[begin : begin + _SEGMENT + max(self.options.coarse_widths)]
            at = np.flatnonzero(part < len(self.space.words))
            if len(at) < fewest:
                continue
            blocks = -(-len(part) // step)
            running = np.zeros((blocks + 1, vectors.shape[1]), np.float32)
            block = at // step
            first = np.flatnonzero(np.diff(block, prepend=-1))
            running[block[first] + 1] = np.add.reduceat(vectors.take(part[at], axis=0), first, axis=0)
            np.cumsum(running, axis=0, out=running)
            known = np.zeros(blocks + 1, np.int64)
            np.cumsum(np.bincount(block, minlength=blocks), out=known[1:])
            starts, ends = [], []
            for width in self.options.coarse_widths:
                start = np.arange(0, max(1, blocks - width // step + self.options.coarse_step // step), self.options.coarse_step // step)
                starts.append(start)
                ends.append(np.minimum(start + width // step, blocks))
            start, end = np.concatenate(starts), np.concatenate(ends)
            enough = np.flatnonzero(known[end] - known[start] >= fewest - 1)  # a cut window of the shortest item
            if not len(enough):
                continue
            start, end = start[enough], end[enough]
            window = running[end] - running[start]
            norms = np.sqrt(np.einsum("ij,ij->i", window, window)) + 1e-9
            place, item = np.nonzero(window @ items.T >= self.options.coarse * norms[:, None])
            near = np.c_[start[place], item, end[place] - start[place]]
            if len(near):
                self._refine(running, near, begin, found)
        return found

    def _refine(self, running: np.ndarray, near: np.ndarray, begin: int, found: dict[tuple[int, int], tuple[float, int]]) -> None:
        """Adds the best fine window of each (start, item, size) in blocks, where its cosine is high enough."""
        step, blocks = self.options.step, len(running) - 1
        margin = self.options.coarse_step // step
        sizes = [w // step for w in self.options.widths]
        norms = {}
        for size in sizes:
            window = running[np.minimum(np.arange(blocks) + size, blocks)] - running[:-1]
            norms[size] = np.sqrt(np.einsum("ij,ij->i", window, window)) + 1e-9
        places = np.arange(-margin, self.options.coarse_widths[-1] // step + margin + max(sizes) + 1)
        for chunk in range(0, len(near), _PAIRS):
            start, item, wide = near[chunk : chunk + _PAIRS].T
            edges = np.clip(start[:, None] + places, 0, blocks)
            along = np.einsum("pkr,pr->pk", running[edges], self.space.item_vectors[item])
            best, where, width = np.full(len(item), -1.0), np.zeros(len(item), np.int64), np.zeros(len(item), np.int64)
            rows = np.arange(len(item))
            for size in sizes:
                a = np.minimum(edges[:, :-size], blocks - 1)
                cosine = (along[:, size:] - along[:, :-size]) / norms[size][a]
                cosine[places[:-size] >= (wide + margin)[:, None]] = -1
                top = cosine.argmax(axis=1)
                value = cosine[rows, top]
                better = value > best
                best[better], width[better], where[better] = value[better], size, a[rows, top][better]
            for k in np.flatnonzero(best >= self.options.cosine).tolist():
                key = (int(item[k]), begin + step * int(where[k]))
                if best[k] > found.get(key, (0.0, 0))[0]:
                    found[key] = (float(best[k]), step * int(width[k]))

    def _judged(self, ids: np.ndarray, near: list[tuple[float, int, int, int]]) -> list[tuple[int, int, int, float]]:
        """The leaks among the candidates (cosine, item, start, width) of one text; the best place of each item."""
        best: dict[int, tuple[int, float]] = {}
        seen: dict[int, list[tuple[int, int]]] = {}
        for cosine, item, start, width in sorted(near, key=lambda c: (-c[0], c[1:])):
            reach = int(self.reach[item])
            low, high = max(0, start - reach), start + width + reach
            # words that a better candidate of the item has been compared with already
            if any(a <= start and start + width <= b for a, b in seen.get(item, ())):
                continue
            seen.setdefault(item, []).append((low, high))
            common = self._best(item, ids[low:high].tolist())
            if common and (common, cosine) > best.get(item, (0, 0.0)):
                best[item] = (common, cosine)
        for item, common, _ in self.by_words(ids, self.short):
            if common >= self.options.least_exact or common == len(ids):
                best[item] = (common, 1.0)
        return [(self.space.item_ids[i], common, len(self.space.items[i]), cosine) for i, (common, cosine) in sorted(best.items())]

    def leaks_in(self, bodies: list[bytes]) -> Iterator[list[tuple[int, int, int, float]]]:
        """(item_id, common words, item words, cosine) of the items each text leaks."""
        return self.leaks_among(_ids(self.index, body) for body in bodies)

    def leaks_among(self, documents: Iterable[np.ndarray]) -> Iterator[list[tuple[int, int, int, float]]]:
        """The same of texts given as word ids.

        Short texts are searched together, with unknown words between them that no window reaches across.
        """
        gap = np.full(max(self.options.coarse_widths) + self.options.coarse_step, len(self.space.words), np.int32)
        held: list[np.ndarray] = []
        size = 0

        def judged() -> Iterator[list[tuple[int, int, int, float]]]:
            parts = [x for ids in held for x in (ids, gap)]
            begins = np.cumsum([0, *[len(ids) + len(gap) for ids in held]])
            near: list[list[tuple[float, int, int, int]]] = [[] for _ in held]
            for (item, start), (cosine, width) in (self.candidates(np.concatenate(parts)) if parts else {}).items():
                k = int(np.searchsorted(begins, start, side="right")) - 1
                near[k].append((cosine, item, start - int(begins[k]), width))
            for ids, found in zip(held, near, strict=True):
                yield self._judged(ids, found)

        for ids in documents:
            if held and size + len(ids) > _SEGMENT:
                yield from judged()
                held, size = [], 0
            held.append(ids)
            size += len(ids) + len(gap)
        yield from judged()

    def leaks(self, text: bytes) -> list[tuple[int, int, int, float]]:
        return next(self.leaks_in([text]))


def _blocks(benchmark: DataFrame, item: str, text: str, options: Options) -> Iterator[_Items]:
    """The items in order of id, a block at a time; the driver holds one block's texts."""
    rows = benchmark.select(F.col(item).alias("i"), F.col(text).alias("t")).filter("i IS NOT NULL AND t IS NOT NULL").distinct().orderBy("i", "t")
    held: list[tuple[int, str]] = []
    words: set[bytes] = set()
    for row in rows.toLocalIterator():
        more = set(words_of(row["t"].encode()))
        if held and (len(held) >= options.block or len(words | more) > options.block_words):
            yield _items(held)
            held, words = [], set()
        held.append((row["i"], row["t"]))
        words |= more
    if words:
        yield _items(held)


@dataclass(frozen=True)
class _Round:
    """A few blocks of items, and the documents in their words."""

    words: tuple[bytes, ...]
    read: DataFrame
    different: DataFrame
    spaces: list[Space]

    def discard(self) -> None:
        discard(self.read)
        discard(self.different)


def _rounds(docs: DataFrame, benchmark: DataFrame, text: str, item: str, item_text: str, options: Options) -> Iterator[_Round]:
    """The spaces of a few blocks at a time."""
    todo: list[_Items] = []

    def fitted() -> _Round:
        words = tuple(sorted({w for block in todo for w in block.words}))
        read = written(_read(docs, text, words), "latent-read")
        different = written(_different(read), "latent-different")
        held, n = _frequencies(different, words)
        index = {w: i for i, w in enumerate(words)}
        spaces = [fit(different, words, block, held[[index[w] for w in block.words]], n, options) for block in todo]
        return _Round(words, read, different, spaces)

    for block in _blocks(benchmark, item, item_text, options):
        todo.append(block)
        if len(todo) == options.blocks:
            yield fitted()
            todo = []
    if todo:
        yield fitted()


LEAK = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("common", T.LongType()), T.StructField("words", T.LongType()), T.StructField("cosine", T.DoubleType())]))


def leaked(text: Column, spaces: list[Space], options: Options = Options(), known: tuple[bytes, ...] | None = None) -> Column:
    """The items of some blocks that a text leaks, as an array; with `known`, the text is given as ids of these words."""
    places = None if known is None else [_places(known, space.words) for space in spaces]
    read_as = None if known is None else _kind(known)

    @F.arrow_udf(LEAK)
    def find(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = [Matcher(space, options) for space in spaces]
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("common", pa.int64()), ("words", pa.int64()), ("cosine", pa.float64())]))
        for values in columns:
            bodies = [v.as_py() or b"" for v in values.cast(pa.large_binary())]
            if places is None:
                by_block = zip(*[m.leaks_in(bodies) for m in own], strict=True)
            else:
                by_block = zip(*[m.leaks_among([p[np.frombuffer(b, read_as)] for b in bodies]) for m, p in zip(own, places, strict=True)], strict=True)
            yield pa.array([[dict(zip(("item_id", "common", "words", "cosine"), row, strict=True)) for rows in found for row in rows] for found in by_block], kind)

    return find(text)


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", options: Options = Options()) -> DataFrame:
    """(id, item_id, common, words, cosine) of every leak; a round's leaks are written, and its documents in ids removed."""
    bodies = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    result = None
    for part in _rounds(bodies, benchmark, "text", item, item_text, options):
        found = part.different.select("digest", F.explode(leaked(F.col("ids"), part.spaces, options, part.words)).alias("leak"))
        mine = written(part.read.select("id", "digest").join(found, "digest").select("id", "leak.*"), "latent-leaks")
        part.discard()
        result = mine if result is None else result.union(mine)
    if result is None:
        return bodies.select("id", F.lit(0).cast("bigint").alias("item_id"), F.lit(0).cast("bigint").alias("common"), F.lit(0).cast("bigint").alias("words"), F.lit(0.0).alias("cosine")).filter("false")
    return result


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", options: Options = Options()) -> DataFrame:
    """The rows that leak no item, with the columns they came with."""
    kept = docs
    for part in _rounds(docs.select(F.col(text).alias("text")), benchmark, "text", item, item_text, options):
        part.discard()
        kept = kept.filter(F.coalesce(F.size(leaked(F.col(text), part.spaces, options)), F.lit(0)) <= 0)
    return kept
