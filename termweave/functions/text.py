"""Column expressions over free text: words, trigrams, signatures, similarity (T-01, T-02, T-08)."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termweave.functions.stem import porter

# The usual English stop words of full-text search.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself "
    "she her hers herself it its itself they them their theirs themselves what which who whom this "
    "that these those am is are was were be been being have has had having do does did doing a an "
    "the and but if or because as until while of at by for with about against between into through "
    "during before after above below to from up down in out on off over under again further then "
    "once here there when where why how all any both each few more most other some such no nor not "
    "only own same so than too very s t can will just don should now"
).split()

SIGNATURE_WORDS = 4
WORD_BREAK = r"[^\p{L}\p{N}]+"


def word_text(c: Column) -> Column:
    """The lower-case words of a text, joined by single blanks."""
    return F.trim(F.regexp_replace(F.lower(c), WORD_BREAK, " "))


def words(c: Column) -> Column:
    """Lower-case words in text order; empty for a text without letters or digits."""
    text = word_text(c)
    return F.when(F.length(text) > 0, F.split(text, " ")).otherwise(F.array().cast("array<string>"))


def is_stop_word(word: Column) -> Column:
    return word.isin(STOP_WORDS)


def trigram_sequence(c: Column) -> Column:
    """Trigrams in text order; every word is padded with two leading blanks and a trailing one."""

    def of_word(word: Column) -> Column:
        padded = F.concat(F.lit("  "), word, F.lit(" "))
        return F.transform(
            F.sequence(F.lit(1), F.length(word) + 1), lambda i: F.substring(padded, i, F.lit(3))
        )

    return F.flatten(F.transform(words(c), of_word))


def trigrams(c: Column) -> Column:
    return F.array_distinct(trigram_sequence(c))


def trgm_similarity(a: Column, b: Column) -> Column:
    """Shared over united trigrams of two distinct-trigram arrays; 0 when both are empty."""
    shared = F.size(F.array_intersect(a, b))
    united = F.size(a) + F.size(b) - shared
    return F.when(united > 0, shared / united).otherwise(F.lit(0.0))


def signature_bits(items: str) -> Column:
    """The distinct signature bits of an array column: at most 256, however long the array."""
    bits = 64 * SIGNATURE_WORDS
    return F.array_distinct(F.transform(items, lambda x: F.pmod(F.xxhash64(x), F.lit(bits)).cast("int")))


def signature(bits: str, word: int) -> Column:
    """One 64-bit word of the signature (a superimposed code) from its distinct bits."""
    return F.expr(
        f"aggregate({bits}, 0L, (acc, b) -> if(b div 64 = {word}, acc | shiftleft(1L, b % 64), acc))"
    )


def signature_columns(bits: str, prefix: str) -> dict[str, Column]:
    return {f"{prefix}{w}": signature(bits, w) for w in range(SIGNATURE_WORDS)}


def signature_overlap(left: str, right: str) -> Column:
    """Number of signature bits two rows share."""
    total = F.lit(0)
    for w in range(SIGNATURE_WORDS):
        total = total + F.bit_count(F.col(f"{left}{w}").bitwiseAND(F.col(f"{right}{w}")))
    return total


def signature_size(prefix: str) -> Column:
    total = F.lit(0)
    for w in range(SIGNATURE_WORDS):
        total = total + F.bit_count(F.col(f"{prefix}{w}"))
    return total


def signature_covers(whole: str, part: str) -> Column:
    """True when every bit of `part` is set in `whole` (no false negatives for subset tests)."""
    test = F.lit(True)
    for w in range(SIGNATURE_WORDS):
        bits = F.col(f"{part}{w}")
        test = test & (F.col(f"{whole}{w}").bitwiseAND(bits) == bits)
    return test


@F.arrow_udf(T.ArrayType(T.StringType()))
def stem_words(batch: pa.Array) -> pa.Array:
    """Porter stems of word arrays, one Arrow batch at a time; only the different words of a batch become Python strings."""
    words = batch.flatten().dictionary_encode()
    stems = pa.array([porter(w) for w in words.dictionary.to_pylist()], pa.string()).take(words.indices)
    sizes = batch.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype("int32"))
    return pa.ListArray.from_arrays(offsets, stems, mask=batch.is_null())


@lru_cache(maxsize=50_000)
def _trigram_list(text: str) -> tuple[str, ...]:
    return tuple(f"  {w} "[i : i + 3] for w in text.split(" ") if w for i in range(len(w) + 1))


@lru_cache(maxsize=50_000)
def _trigram_set(text: str) -> frozenset[str]:
    return frozenset(_trigram_list(text))


def best_extent(query: str, text: str) -> float:
    """Greatest Jaccard similarity between the query's trigrams and those of any contiguous
    run of the text's trigram sequence. Both arguments are `word_text` forms.

    A best run starts and ends with a trigram of the query. A run is given up as soon as all
    the trigrams it could still gain would not lift it above the best one found.
    """
    wanted = _trigram_set(query)
    n = len(wanted)
    sequence = _trigram_list(text)
    hits = [i for i, g in enumerate(sequence) if g in wanted]
    if not n or not hits:
        return 0.0
    later: set[str] = set()
    gains = []  # different trigrams of the query from each hit on
    for i in reversed(hits):
        later.add(sequence[i])
        gains.append(len(later))
    best = 0.0
    for start, gain in zip(hits, reversed(gains)):
        if gain <= best * n:
            break
        seen: set[str] = set()
        matched = 0
        for gram in sequence[start:]:
            if gram in seen:
                continue
            seen.add(gram)
            united = n + len(seen) - matched
            if gram in wanted:
                matched += 1
                if matched > best * (united - 1):
                    best = matched / (united - 1)
                if matched == gain:
                    break
            elif gain <= best * united:
                break
    return best


@F.pandas_udf(T.DoubleType())
def _word_similarity(query: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([best_extent(q, t) for q, t in zip(query, text)], dtype="float64")


# `best_extent` over pairs, an Arrow batch at a time. Declared non-deterministic so that a filter
# on its result is not moved below the cheap filters that come first and evaluated a second time.
word_similarity = _word_similarity.asNondeterministic()
