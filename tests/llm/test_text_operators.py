"""Rules, tokens and merges: operators that judge each row by itself."""

import re
from collections import Counter
from functools import lru_cache

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from termweave.llm import bpe, host_rules, queries, token_counts

from .conftest import odd_rows, prose

PIECES = public_tokenizers.path("piece_bpe_32k.model")
RANKS = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered = {p for i, w in enumerate(windows) if w in often for p in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


def test_rule_counts_match_plain_python(spark):
    texts = [t for _, t, *_ in odd_rows()] + ["a b c a b c a b c", "x x x x", "a\n\na\n b\n b\na", "#| <b>&", "one two three\x0bfour\x1ffive", " ".join(["of the"] * 300)]
    docs = spark.createDataFrame([(i, t, "h") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    judged, rules = host_rules.host_rules(docs, keep=["doc_id"])
    got = {r["doc_id"]: tuple(r[rules][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) for r in judged.collect()}
    assert got == {i: plain_counts(t) for i, t in enumerate(texts)}


def test_rules_keep_rows_and_columns(odd, none):
    kept = host_rules.passing(odd)
    assert kept.schema == odd.schema
    rows = [tuple(r) for r in kept.collect()]
    assert set(rows) <= set(odd_rows())
    assert sum(r[0] == 2 for r in rows) == 2 and not any(r[1] in (None, "", "a") for r in rows)
    assert host_rules.passing(none).count() == 0


def test_suspect_host_binds_the_strict_limit(spark):
    """The same mild text stays on a good host and goes from a host that fails almost always; few documents are not enough."""
    mild = " ".join(f"w{i}" for i in range(90)) + " " + "# " * 15
    bad = " ".join(f"w{i}" for i in range(60)) + " " + "# " * 20
    good = prose(1, 100)
    rows = [(i, bad, "junk") for i in range(200)] + [(1000, mild, "junk"), (1001, mild, "fine"), (1002, mild, "new"), (1003, good, "junk")]
    rows += [(2000 + i, prose(i, 100), "fine") for i in range(200)] + [(3000 + i, prose(i, 100), f"h{i % 20}") for i in range(400)]
    kept = {r["doc_id"] for r in host_rules.passing(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert 1000 not in kept and {1001, 1002, 1003} <= kept


def test_rules_stay_native(odd):
    plan = host_rules.passing(odd)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_token_counts(spark, odd, none):
    model = token_counts._model(PIECES)
    got = sorted(((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.count_tokens(odd, PIECES).collect()))
    want = sorted((i or -1, len((t or "").encode()), len(model.encode(t or "")), len(model.encode(t or "")) > 4096) for i, t, *_ in odd_rows())
    assert got == want
    assert token_counts.count_tokens(none, PIECES).count() == 0


@pytest.mark.parametrize("limit", [1, 7, 100])
def test_parts_have_the_pieces_of_the_whole(limit):
    model = token_counts._model(PIECES)
    assert token_counts.safe_to_cut(PIECES)
    for text in [prose(1, 300), "  a  b c ", "x▁y z w", "<s> a b </s>", "ab\ncd ef\tgh ij", "é è a b ﬁ c"]:
        assert sum(token_counts._lengths(PIECES, list(token_counts.parts(text, limit)))) == len(model.encode(text))


@lru_cache
def small_leaf(leaf):
    return bpe.Codec(*RANKS, leaf)


PIECE = st.sampled_from(["a", "b", " ", "  ", "é", "\n", "'s", "'re", "中", "🙂", "1", "!", "the", " of", "\t", "ing", "aaaa", "́"])


@pytest.mark.parametrize("leaf", [3, 16])
@settings(max_examples=150, deadline=None)
@given(st.lists(PIECE, max_size=100).map("".join))
def test_tree_encoding_is_the_librarys(leaf, text):
    own = small_leaf(leaf)
    ids = own.encode(text)
    assert ids == own.library.encode_ordinary(text)
    assert own.decode(ids) == text.encode()


def test_long_matches_are_trees():
    own = bpe.Codec(*RANKS, 32)
    for text in ["a" * 3000, "ingtheof" * 300, "中文" * 500, " " * 2000, "ab" * 900 + " b", "\n \n" * 300]:
        assert own.encode(text) == own.library.encode_ordinary(text)


def test_bpe_columns(spark, odd, none):
    own = bpe.Codec(*RANKS)
    ids = odd.select("doc_id", "text", bpe.encoded(F.col("text"), *RANKS).alias("ids"))
    rows = ids.withColumn("back", bpe.decoded(F.col("ids"), *RANKS)).collect()
    assert len(rows) == len(odd_rows())
    for r in rows:
        assert r["ids"] == own.library.encode_ordinary(r["text"] or "") and bytes(r["back"]) == (r["text"] or "").encode()
    assert queries.bpe_digests(none).count() == 0
    assert {r["n_tokens"] for r in queries.bpe_digests(odd).filter("doc_id = 4").collect()} == {0}
