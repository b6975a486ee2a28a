"""Token counts: batches of texts encoded inside Arrow functions that return lengths only.

Batches are cut by bytes, so a task holds a bounded number of ids however long its rows are. A text longer than the limit is
cut first, at places where the library must start a new piece; the lengths of the parts add up to the length of the whole.

Safe places: no piece of the vocabulary holds the word mark after another character, and runs of blanks are neither folded
nor trimmed. So a cut before a single blank between two ASCII letters lies between two pieces, and the part after
it, given without that blank, gets the same mark back as the library's own prefix. `safe_to_cut` checks both facts of a model;
where they do not hold, texts stay whole.

Defined results: null and empty texts have 0 bytes and 0 tokens. Rows are counted in place: repeated rows, null ids and
extra columns pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH_BYTES = 1 << 20
CUT_BYTES = 1 << 16
_CUT = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")
_MODELS: dict[str, object] = {}


def _model(path: str):
    """The tokenizer of a file, loaded once per Python worker."""
    if path not in _MODELS:
        if path.endswith(".model"):
            import sentencepiece

            _MODELS[path] = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            from tokenizers import Tokenizer

            _MODELS[path] = Tokenizer.from_file(path)
    return _MODELS[path]


def safe_to_cut(path: str) -> bool:
    """Whether parts cut before single blanks have the pieces of the whole."""
    if not path.endswith(".model"):
        return False
    model = _model(path)
    mark = "▁"
    inside = any(mark in model.id_to_piece(i).lstrip(mark) for i in range(model.get_piece_size()))
    probe = "ab  cd e "
    return not inside and model.encode("x y") == model.encode("x") + model.encode("y") and model.decode(model.encode(probe)) == probe


def parts(text: str, limit: int = CUT_BYTES) -> Iterator[str]:
    """Cut a text at safe places into parts of about `limit` characters."""
    start = 0
    while len(text) - start > limit:
        found = _CUT.search(text, start + limit)
        if not found:
            break
        yield text[start : found.start()]
        start = found.end()
    yield text[start:] if start else text


def _lengths(path: str, strings: list[str]) -> list[int]:
    model = _model(path)
    if path.endswith(".model"):
        return [len(ids) for ids in model.encode(strings, num_threads=1)]
    return [len(e.ids) for e in model.encode_batch(strings, add_special_tokens=False)]


def batch_lengths(path: str, strings: list[str], cut: bool) -> list[int]:
    """The lengths of some texts, encoded in runs of about BATCH_BYTES."""
    lengths = [0] * len(strings)
    rows: list[int] = []
    held: list[str] = []
    size = 0

    def flush() -> None:
        for row, n in zip(rows, _lengths(path, held), strict=True):
            lengths[row] += n
        rows.clear()
        held.clear()

    for i, text in enumerate(strings):
        for part in parts(text) if cut else (text,):
            rows.append(i)
            held.append(part)
            size += len(part)
            if size >= BATCH_BYTES:
                flush()
                size = 0
    if held:
        flush()
    return lengths


def token_count(text: Column, path: str) -> Column:
    """The number of tokens of a text by the tokenizer at `path`, as bigint."""
    cut = safe_to_cut(path)

    @F.arrow_udf(T.LongType())
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for values in batches:
            yield pa.array(batch_lengths(path, pc.fill_null(values, "").to_pylist(), cut), pa.int64())

    return F.coalesce(count(text), F.lit(0).cast("bigint"))


def count_tokens(docs: DataFrame, path: str, text: str = "text", limit: int = 4096) -> DataFrame:
    """All columns of `docs` but the text, n_bytes, n_tokens and over_limit; clashing columns of `docs` give way."""
    added = {"n_bytes", "n_tokens", "over_limit", text.lower()}
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in added]
    sized = docs.select(*kept, F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("bigint").alias("n_bytes"), token_count(F.col(text), path).alias("n_tokens"))
    return sized.withColumn("over_limit", F.col("n_tokens") > limit)
