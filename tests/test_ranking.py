"""Ranking operators against a second, plain formulation over random tables."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from termweave import session
from termweave.operators import ranking as R

ROWS = "query_id int, concept_id long, score double, matched_on string, source int, source_rank int"
CONCEPTS = "concept_id long, code string, is_billable boolean, sort_order int"
EXPANSION = "category string, child_id long, child_code string, child_order int, i int"
HITS = "query_id int, rank int, concept_id long, code string, sort_order int, score double, matched_on string, variants array<string>"


def leaf(k):
    return f"G{k // 9:02d}.{k // 3 % 3}00{'MNP'[k % 3]}"


def stem(code):
    return code[:-1] if len(code.replace(".", "")) == 7 else code


@pytest.fixture(scope="module")
def world(spark):
    """Leaves in families of three, a category per nine of them, and rows that point at both or at nothing."""
    pick = random.Random(17)
    concepts = [(k, leaf(k), True, 100 + 2 * k) for k in range(45)] + [(200 + c, f"G{c:02d}", False, 90 + c) for c in range(5)]
    expansion = [(f"G{c:02d}", k, leaf(k), 100 + 2 * k, i) for c in range(5) for i, k in enumerate(range(9 * c, 9 * c + 4))]
    rows = []
    for q in range(6):
        for place in range(1, 30):
            target = pick.choice([pick.randrange(45), 200 + pick.randrange(5), 999])
            rows.append((q, target, pick.randrange(1, 9) / 8, pick.choice([None, "alias"]), place % 2, place))
    return rows, concepts, expansion


def plain_merge(rows, concepts):
    known = {c[0]: c for c in concepts}
    best = {}
    for q, cid, score, matched, source, place in rows:
        if cid in known and ((q, cid) not in best or (score, -source, -place) > best[q, cid][0]):
            best[q, cid] = ((score, -source, -place), matched)
    out = defaultdict(list)
    for (q, cid), ((score, *_), matched) in best.items():
        out[q].append((-score, known[cid][3], known[cid][1], cid, score, matched, known[cid][2]))
    return {q: sorted(v, key=lambda x: x[:3]) for q, v in out.items()}


def by_query(df, *columns):
    out = defaultdict(list)
    for r in df.orderBy("query_id", "rank").collect():
        out[r.query_id].append(tuple(r[c] for c in columns))
    return dict(out)


def test_merge(spark, world):
    rows, concepts, _ = world
    merged = R.merge_candidates(spark.createDataFrame(rows, ROWS), spark.createDataFrame(concepts, CONCEPTS))
    want = {q: [(x[2], x[4], x[5]) for x in v] for q, v in plain_merge(rows, concepts).items()}
    assert by_query(merged, "code", "score", "matched_on") == want


def test_expand(spark, world):
    rows, concepts, expansion = world
    merged = plain_merge(rows, concepts)
    want = {}
    for q, found in merged.items():
        best = {}
        for via, (_, order, code, cid, score, matched, billable) in enumerate(found, 1):
            reached = [(cid, code, order, 0)] if billable else [e[1:] for e in expansion if e[0] == code]
            for child, child_code, child_order, i in reached:
                key = (score - R.EXPAND_DECAY * i, billable, -via)
                if child not in best or key > best[child][0]:
                    best[child] = (key, child_code, child_order, matched)
        want[q] = [(code, matched) for (k, code, order, matched) in sorted(best.values(), key=lambda v: (-round(v[0][0], 9), v[2], v[1]))]
    got = R.expand_to_billable(
        R.merge_candidates(spark.createDataFrame(rows, ROWS), spark.createDataFrame(concepts, CONCEPTS)), spark.createDataFrame(expansion, EXPANSION))
    assert by_query(got, "code", "matched_on") == want


def random_hits(seed):
    pick = random.Random(seed)
    return [(q, place + 1, k, leaf(k), 100 + 2 * k, 1 - place / 20, pick.choice([None, f"n{seed}"])) for q in range(6) for place, k in enumerate(pick.sample(range(27), 12))]


def plain_collapse(hits):
    out = defaultdict(dict)
    for q, rank, cid, code, order, score, matched in hits:
        out[q].setdefault(stem(code), []).append((rank, code, matched))
    return {q: [(m[0][1], [x[1] for x in m[1:]], m[0][2]) for m in sorted((sorted(v) for v in families.values()))] for q, families in out.items()}


def collapsed(spark, hits):
    ranked = spark.createDataFrame([(*h, True) for h in hits], HITS.replace("variants array<string>", "is_billable boolean"))
    return R.collapse_variants(ranked)


def test_collapse(spark):
    hits = random_hits(1)
    assert by_query(collapsed(spark, hits), "code", "variants", "matched_on") == plain_collapse(hits)


@pytest.mark.parametrize("weight", [1.0, 0.25])
def test_fuse(spark, weight):
    sides = [random_hits(2), random_hits(3)]
    text, semantic = (plain_collapse(s) for s in sides)
    order = {leaf(k): 100 + 2 * k for k in range(27)}
    want = {}
    for q in text:
        t = {stem(c): (rank, c, v, m) for rank, (c, v, m) in enumerate(text[q], 1)}
        s = {stem(c): (rank, c, v, m) for rank, (c, v, m) in enumerate(semantic[q], 1)}
        rows = []
        for key in t.keys() | s.keys():
            score = (weight / (R.RRF_K + t[key][0]) if key in t else 0) + (1 / (R.RRF_K + s[key][0]) if key in s else 0)
            _, code, variants, matched = t.get(key) or s[key]
            if key in t and key in s:
                variants = variants + [c for c in [s[key][1], *s[key][2]] if c != code and c not in variants]
            rows.append((-round(score, 12), order[code], code, variants, matched, t.get(key, [None])[0], s.get(key, [None])[0]))
        want[q] = [tuple(r[2:]) for r in sorted(rows, key=lambda r: r[:3])]
    fused = R.rrf_fuse(*(collapsed(spark, s) for s in sides), text_weight=weight)
    assert by_query(fused, "code", "variants", "matched_on", "text_rank", "semantic_rank") == want


def test_fuse_by_code_keeps_family_members_apart(spark):
    rows = [(0, k + 1, k, leaf(k), k, 1.0, None, []) for k in (0, 1, 2, 9)]
    hits = spark.createDataFrame([(q, n + 1, *rest) for n, (q, _, *rest) in enumerate(rows)], HITS)
    fused = R.rrf_fuse(hits, hits, by_stem=False).collect()
    assert len(fused) == 4 and not any(r.variants for r in fused)


def test_ranking_plans_have_no_nested_loop(spark, world):
    rows, concepts, expansion = world
    merged = R.merge_candidates(spark.createDataFrame(rows, ROWS), spark.createDataFrame(concepts, CONCEPTS))
    plan = R.expand_to_billable(merged, spark.createDataFrame(expansion, EXPANSION))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_fused_lists_are_placed_once(spark, world):
    """One exchange a method, of the candidates; the widened lists are neither shuffled by key nor by query again."""
    rows, concepts, expansion = world

    def hits():
        merged = R.merge_candidates(spark.createDataFrame(rows, ROWS), F.broadcast(spark.createDataFrame(concepts, CONCEPTS)))
        return R.as_hits(R.expand_to_billable(merged, spark.createDataFrame(expansion, EXPANSION)))

    plan = R.rrf_fuse(hits(), hits(), by_stem=False)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2


def test_fuse_with_repeated_and_missing_keys(spark):
    """A repeated code meets each of the other list's; a row without a query or a code meets none."""
    hits = [(0, 1, 1, "A", 1), (0, 2, 2, "A", 2), (0, 3, 3, None, 3), (None, 1, 1, "A", 1)]
    table = spark.createDataFrame([(*h, 1.0, None, []) for h in hits], HITS)
    fused = R.rrf_fuse(table, table, by_stem=False)
    got = sorted((str(r.query_id), str(r.code), str(r.text_rank), str(r.semantic_rank)) for r in fused.collect())
    pairs = [("0", "A", t, s) for t in "12" for s in "12"]
    assert got == sorted([*pairs, ("0", "None", "3", "None"), ("0", "None", "None", "3"), ("None", "A", "1", "None"), ("None", "A", "None", "1")])


def test_tasks_follow_the_bytes_read(spark, tmp_path):
    """Lists are placed over more tasks when their table is larger, wherever its files lie."""
    path = str(tmp_path / "a table")
    spark.range(1000).repartition(2).write.parquet(path)
    table = spark.read.parquet(path)
    files = list((tmp_path / "a table").glob("*.parquet"))
    assert session.input_bytes(table) == sum(f.stat().st_size for f in files) > 0
    assert session.input_bytes(spark.createDataFrame([(1,)], "id int")) == 0
    assert session.spread(table, table, "id").rdd.getNumPartitions() == session.width(spark)
