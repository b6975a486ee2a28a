"""Source mixing, the prefix trie and spelling variants against plain formulations, with odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from termweave.llm import mixing, prefix_trie, spelling

from .conftest import prose


def level_of(sizes, mix):
    """source -> target, sources in code-point order with None last."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: mix.shares[i % len(mix.shares)] for i, s in enumerate(order)}
    volume, full = mix.volume * sum(sizes.values()), set()
    while len(full) < len(order):
        level = (volume - sum(mix.most * sizes[s] for s in full)) / sum(w for s, w in weight.items() if s not in full)
        above = {s for s in order if s in full or weight[s] * level > mix.most * sizes[s]}
        if above == full:
            return {s: mix.most * sizes[s] if s in full else weight[s] * level for s in order}
        full = above
    return {s: mix.most * sizes[s] for s in order}


def plain_mix(rows, mix):
    """Sorted (id, size, source_size, target, taken) of rows (id, text, source)."""
    measured = []
    for i, text, source in rows:
        body = text or ""
        size = len(body.encode().split())
        usual = len([c for c in body if c not in mixing.UNUSUAL]) / max(1, len(body))
        drawn = int(hashlib.md5(f"{mix.seed}:{'' if i is None else i}".encode()).hexdigest()[:13], 16)
        key = -math.log((drawn + 0.5) / 2**52) / max(usual, mixing.LEAST_WEIGHT)
        measured.append((source, key, "" if i is None else str(i), size, i))
    sizes = Counter()
    for source, *_, size, _ in measured:
        sizes[source] += size
    goal, out = level_of(sizes, mix), []
    for s in sizes:
        epochs = int(goal[s] // sizes[s]) if sizes[s] else 0
        rest, start = math.floor(goal[s]) - epochs * sizes[s], 0
        for _, _, _, size, i in sorted((m for m in measured if m[0] == s), key=lambda m: m[1:4]):
            out.append((i, size, sizes[s], goal[s], epochs * size + max(0, min(size, rest - start))))
            start += size
    return sorted(out, key=str)


def mixed_rows(df, mix=None):
    rows, into = mixing.mixed(df, mixing.word_count(F.col("text")), mixing.quality_weight(F.col("text")), keep=["doc_id"], mix=mix)
    return sorted([tuple(r) for r in rows.select("doc_id", *[f"{into}.{c}" for c in ("size", "source_size", "target", "taken")]).collect()], key=str)


@pytest.mark.parametrize("mix", [mixing.Mix(), mixing.Mix(shares=(1, 3), volume=0.4, seed="x"), mixing.Mix(volume=2.0), mixing.Mix(shares=(40, 1), volume=1.1)])
def test_mix_matches_the_plain_one(spark, mix):
    pick = random.Random(5)
    rows = [(k, prose(k, pick.choice([0, 1, 5, 60])) + pick.choice(["", " ##", "\n"]), pick.choice(["a", "a", "a", "a", "b", "ß", "z", None])) for k in range(300)]
    got = mixed_rows(spark.createDataFrame(rows, "doc_id long, text string, source string"), mix)
    assert got == plain_mix(rows, mix)
    taken = Counter()
    for _, _, size, target, n in got:
        taken[size, target] += n
    assert all(abs(n - target) < 1 for (_, target), n in taken.items())


def test_odd_rows_in_the_mix(spark, odd, none):
    rows = [(r.doc_id, r.text, r.source) for r in odd.collect()]
    assert mixed_rows(odd) == plain_mix(rows, mixing.Mix())
    assert mixed_rows(none) == []
    clash = odd.withColumn("mix", F.lit(1)).withColumn("host", F.lit(2)).withColumn("cell", F.lit(3))
    full, into = mixing.mixed(clash, mixing.word_count(F.col("text")), F.lit(None))
    assert into == "mix_" and full.columns == [*clash.columns, "mix_"] and full.count() == odd.count()


def test_heavy_rows_come_first_and_copies_hold_what_is_taken(spark):
    rows = [(k, "w " * 10 if k % 2 else "# " * 10, "s") for k in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    full, into = mixing.mixed(df, mixing.word_count(F.col("text")), mixing.quality_weight(F.col("text")), mix=mixing.Mix(volume=1.3))
    extra = full.filter(F.col(f"{into}.taken") > 10).groupBy((F.col("doc_id") % 2).alias("odd")).count()
    seen = {r["odd"]: r["count"] for r in extra.collect()}
    assert seen[1] > 1.4 * seen[0] and sum(seen.values()) == 600
    texts = mixing.copies(full, into).select(F.sum(mixing.word_count(F.col("text")))).first()[0]
    assert texts == 26_000 == full.select(F.sum(f"{into}.taken")).first()[0]


# ── trie ──


def plain_trie(rows):
    """Nodes of the rebuilt conversations from rows (conv, turn, role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    members, last = defaultdict(set), defaultdict(list)
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        path = tuple(own.get(c - c % 5, [])[:h] + ts[h:])
        for d in range(len(path) + 1):
            members[path[:d]].add(c)
        last[path].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, ms in members.items():
        worth = (len(ms) - 1) * (len(p[-1][1].encode()) if p else 0)
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += worth
    digest = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted(
        (min(ms), len(p), min(members[p[:-1]]) if p else None, len(ms), children[p], leaves[p], saved[p], digest(last[p])) for p, ms in members.items()
    )


TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
TURNS = "conv_id long, turn long, role string, text string, conv string, pos long, ka long"


def trie_rows(spark, rows, block=prefix_trie.BLOCK):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], TURNS)
    turns, convs = prefix_trie.rebuilt(prefix_trie.ordered_turns(df))
    return sorted(tuple(r) for r in prefix_trie.trie(turns, convs, block).select(*TRIE).collect())


def conversations(seed, n, longest):
    pick = random.Random(seed)
    return [
        (c, t, pick.choice(["user", "assistant", None]), pick.choice(["a", "a", "a", "é", "", None]))
        for c in pick.sample(range(3 * n), n) for t in range(pick.randrange(1, longest))
    ]


@pytest.mark.parametrize("block", [1, 2, 4])
def test_trie_matches_the_plain_one(spark, block):
    rows = conversations(3, 120, 14)
    rows += [(c, t, "user", "same start" if t < 6 else f"turn {c % 3}") for c in range(1000, 1060) for t in range(9)]
    assert trie_rows(spark, rows, block) == plain_trie(rows)


def test_odd_conversations(spark):
    rows = [(7, None, "user", "late null"), (7, None, None, None), (7, -3, "user", "x"), (7, 2, "user", "x"), (7, 2, "user", "x"), (None, 1, "a", "b"),
            (10, 0, "u", "long " * 50_000), (11, 0, "u", "long " * 50_000), (13, 5, "", ""), (2**40, 1, "u", "中文 🙂")]
    assert trie_rows(spark, rows) == plain_trie(rows)
    assert trie_rows(spark, []) == []
    turnless = next(c for c in range(16, 1000) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 1)
    rows = [(turnless, 1, "u", "lost with its head")]
    assert trie_rows(spark, rows) == plain_trie(rows) and len(plain_trie(rows)) == 1


def test_long_conversations_and_id_lists_are_cut_into_stretches(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "STRETCH", 8)
    rows = [(c, t, "u", f"{t % 7}" if t < 20 else f"{c} {t}") for c in (0, 5, 10, 15) for t in range(40 + c)]
    rows += [(c, t, "u", "copy") for c in range(100, 180) for t in range(12)] + conversations(9, 30, 30)
    assert trie_rows(spark, rows) == plain_trie(rows)


# ── spelling ──


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    a, b = sorted((a, b), key=len)
    p = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[p + 1 :] == b[p + 1 :] if len(a) == len(b) else a[p:] == b[p + 1 :]


def plain_variants(counts, ratio=5):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    best = {w: min(vs, key=lambda v: (-counts[v], v)) if vs else None for w, vs in near.items()}
    form = {w: b if b and counts[b] >= ratio * counts[w] else None for w, b in best.items()}

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w], root(w), counts[w], len(near[w]), counts[form[w]] if form[w] else None) for w in counts)


def variant_rows(counts_df, options=None):
    got = spelling.variants(counts_df, options)
    return sorted(tuple(r) for r in got.select("word", "form", "root", "n", "n_near", "form_n").collect())


@pytest.mark.parametrize("part", [1, 2, 3, 50])
def test_variants_match_all_pairs(spark, part):
    pick = random.Random(part)
    counts = {}
    for k in range(40):
        word = "".join(pick.choice("abàz") for _ in range(pick.randrange(6, 15)))
        counts[word] = pick.randrange(5, 5000)
        for _ in range(8):
            at, letter = pick.randrange(len(word) + 1), pick.choice("abàz")
            word = pick.choice([word[:at] + letter + word[at:], word[:at] + letter + word[at + 1 :], word[:at] + word[at + 1 :]])
            if len(word) >= 6:
                counts[word] = pick.choice([5, 6, 30, 200])
    counts |= {"a" * n: 10 ** (n % 5) for n in range(6, 30)} | {"aabbaabb": 7, "aabaabb": 7, "b" * 3000: 9, "b" * 2999: 90, "b" * 1500 + "a" + "b" * 1500: 5}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert variant_rows(df, spelling.Spelling(part=part)) == plain_variants(counts)


def test_words_of_odd_texts(spark, odd, none):
    rows = [(1, "Straße ÉCOLE école x1abcdefg ÷×÷×÷×÷"), (2, None), (None, "NULLNULL nullnull"), (3, ""), (4, "abcdef " * 900 + "q" * 100_000), (4, "abcdef " * 900)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit(1)).withColumn("n", F.lit(1)).withColumn("key", F.lit(1))
    plain = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            plain[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 3 == 0 else run] += 1
    options = spelling.Spelling(least_count=1)
    for frame, want in ((df, {w: n for w, n in plain.items() if len(w) >= 6}), (none, {})):
        found = frame.select("doc_id", F.explode(spelling.runs(F.col("text"))).alias("run"))
        counts = spelling.word_counts(found.select(spelling.worn(F.col("doc_id"), F.col("run"), 3).alias("w")), "w", options)
        assert variant_rows(counts, options) == plain_variants(want)
