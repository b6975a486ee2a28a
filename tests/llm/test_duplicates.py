"""The n-gram join and the removal of repeated strings against brute force, and what odd rows give."""

import random
from collections import defaultdict

import numpy as np
import pytest

from termweave.llm import ngram_join, repeats
from termweave.llm.components import components
from termweave.llm.cover import GRAM, anchors

from .conftest import odd_rows, prose


def brute_components(rows, words, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    above = {i: i for i, _ in rows}

    def root(i):
        while above[i] != i:
            i = above[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                above[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def edited(text, edits, seed):
    pick = random.Random(seed)
    words = text.split()
    for _ in range(edits):
        words[pick.randrange(len(words))] = f"edit{pick.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def copies(spark):
    """A dense family of near copies at all distances, small families, shared lines, short texts."""
    base, line = prose(50, 150), prose(51, 12)
    rows = [edited(base, k % 9, k) for k in range(60)] + [prose(100 + k, 80) for k in range(20)]
    rows += [edited(prose(100 + k, 80), e, 7 * k + e) for k in range(8) for e in (1, 2, 4)]
    rows += [line + "\n" + prose(300 + k, 30) for k in range(30)] + [prose(400 + k % 3, k % 9) for k in range(30)]
    rows += ["same few words", "same few words", "SAME few\nwords", "x", "X", "", " "]
    numbered = list(enumerate(rows))
    random.Random(3).shuffle(numbered)
    return numbered, spark.createDataFrame(numbered, "doc_id long, text string")


@pytest.mark.parametrize(("words", "percent", "frequent"), [(4, 85, 2), (5, 80, 16), (1, 60, 4)])
def test_components_match_all_pairs(copies, words, percent, frequent):
    rows, docs = copies
    options = ngram_join.JoinOptions(words=words, percent=percent, frequent=frequent)
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.similar(docs, options=options).collect()}
    assert got == brute_components(rows, words, percent)


def test_odd_rows_in_the_join(odd, none):
    found = ngram_join.similar(odd).collect()
    assert len(found) == len(odd_rows())
    by_id = defaultdict(set)
    for r in found:
        by_id[r["id"]].add((r["n_shingles"] > 0, r["component_id"]))
    assert by_id[None] == {(True, None), (False, None)} and by_id[2] == {(True, 1)} and by_id[7] == {(True, 1)}
    assert by_id[3] == {(False, 3)} and by_id[4] == {(False, 4)}
    assert ngram_join.similar(none).count() == 0
    kept = ngram_join.one_of_each(odd)
    assert kept.schema == odd.schema
    ids = sorted((r["doc_id"] or -1) for r in kept.collect())
    assert ids == [-1, -1, 1, 3, 4, 5, 6, 8, 9, 10]
    assert ngram_join.one_of_each(none).count() == 0


def test_long_chain_is_one_component(spark):
    order = list(range(500))
    random.Random(1).shuffle(order)
    edges = spark.createDataFrame([(a, b) for a, b in zip(order, order[1:], strict=False)] + [(900, 901), (901, 900), (7, 7)], "u long, v long")
    got = {r["node"]: r["component"] for r in components(edges, "test").collect()}
    assert got == {**{i: 0 for i in range(500)}, 900: 900, 901: 900}


def brute_repeats(rows, length):
    seen = defaultdict(int)
    for t in rows:
        for k in range(len(t) - length + 1):
            seen[t[k : k + length]] += 1
    out = []
    for t in rows:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(t), int(gone.sum()), spans, bytes(np.frombuffer(t, np.uint8)[~gone])))
    return out


def test_repeats_match_brute_force(spark):
    pick = random.Random(5)
    base = [prose(700 + k, 90) for k in range(25)]
    rows = list(base)
    for k in range(40):
        a, b = pick.choice(base), pick.choice(base)
        i, j = pick.randrange(400), pick.randrange(400)
        rows.append(a[i : i + pick.randrange(1, 400)] + prose(900 + k, 5) + b[j : j + pick.randrange(190, 230)])
    rows += [base[0], base[1] + "x", "ab" * 300, "ab" * 150 + "c" + "ab" * 150, "z" * 199, "y" * 200, "y" * 200, "", "é" * 150, base[2][:200], base[3][5:204]]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    done, into = repeats.without_repeats(docs)
    got = {r["doc_id"]: (r[into]["n_bytes"], r[into]["n_removed"], r[into]["n_spans"], bytes(r[into]["kept"])) for r in done.collect()}
    assert got == dict(enumerate(brute_repeats([t.encode() for t in rows], 200)))


def test_odd_rows_without_repeats(odd, none):
    done, into = repeats.without_repeats(odd)
    rows = [(t or "").encode() for _, t, *_ in odd_rows()]
    got = sorted((r[into]["n_bytes"], r[into]["n_removed"], r[into]["n_spans"], bytes(r[into]["kept"])) for r in done.collect())
    assert got == sorted(brute_repeats(rows, 200))
    cleaned = repeats.without_repeated_text(odd)
    assert cleaned.schema.names == odd.schema.names and cleaned.count() == len(rows)
    assert sum(r["text"] is None for r in cleaned.collect()) == sum(t is None for _, t, *_ in odd_rows())
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in cleaned.collect())
    assert repeats.without_repeated_text(none).count() == 0


def test_anchors_follow_the_string():
    """Equal strings have their anchor at the same distance, wherever they start."""
    piece = prose(11, 60).encode()
    for before in (b"", b"q", prose(12, 40).encode()):
        text = before + piece + prose(13, 20).encode()
        place, low, high, _ = anchors(text, 200)
        of = np.repeat(place, high - low + 1)
        assert list(low[1:]) == list(high[:-1] + 1) and len(of) == len(text) - 199
        distances = [int(of[len(before) + k]) - len(before) - k for k in range(len(piece) - 199)]
        if not before:
            first = distances
        assert distances == first
        assert all(0 <= d <= 200 - GRAM for d in distances)


BORDER = (1 << 20) - 200


def test_anchors_do_not_see_pass_borders():
    text = (prose(14, 2 * BORDER // 8) + " " * 400).encode()[: 2 * BORDER + 150]
    place, low, high, names = anchors(text, 200)
    assert len(set(place.tolist())) == len(place) and list(low[1:]) == list(high[:-1] + 1)
    for border in (BORDER, 2 * BORDER):
        begin = border - 3000
        near = {(int(p), int(a), int(b), int(n)) for p, a, b, n in zip(place, low, high, names, strict=True) if border - 1000 <= p <= border + 1000 and b < len(text) - 200}
        alone = {(int(p) + begin, int(a) + begin, int(b) + begin, int(n)) for p, a, b, n in zip(*anchors(text[begin : border + 3000], 200), strict=True)}
        assert len(near) > 1 and near <= alone


def test_repeats_at_a_pass_border(spark):
    """200 bytes that start at offsets near a border, each in a long text of its own, and again in a short one."""
    filler = np.random.default_rng(8).integers(97, 123, BORDER + 900, np.uint8).tobytes()
    starts = [BORDER + d for d in (-169, -120, -80, -60, -40, -20, -10, -1, 0, 1, 10, 20, 40, 60, 80, 120, 168)]
    salt = [np.random.default_rng(100 + k).permutation(np.arange(97, 123, dtype=np.uint8)) for k in range(len(starts))]
    rows = []
    for k, s in enumerate(starts):
        text = salt[k][np.frombuffer(filler, np.uint8) - 97].tobytes()
        rows += [(2 * k, text.decode()), (2 * k + 1, "0" + text[s : s + 200].decode() + "1" + prose(4000 + k, 30))]
    done, into = repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["doc_id"]: (r["n"], r["size"]) for r in done.selectExpr("doc_id", f"{into}.n_removed AS n", f"{into}.n_bytes AS size").collect()}
    assert got == {i: (200, len(t)) for i, t in rows}
