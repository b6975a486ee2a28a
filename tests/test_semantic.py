import numpy as np
import pytest

from termweave.operators import semantic as E
from termweave.operators import vector_index as I


def vectors(spark, n=60, d=8):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(n, d)).astype("float32")
    v[10] = v[11]  # a tie
    q = spark.createDataFrame([(i, v[i].tolist()) for i in range(0, n, 7)], "query_id long, embedding array<float>")
    c = spark.createDataFrame([(i, n - i, v[i].tolist()) for i in range(n)], "row_id long, sort_key long, embedding array<float>")
    return v.astype("float64"), q, c


@pytest.mark.parametrize("blocks", [(2048, 20000), (3, 7)])
def test_knn_equals_brute_force(spark, blocks):
    v, q, c = vectors(spark)
    got = {}
    for r in E.knn_topk(q, c, 5, *blocks).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.row_id
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    for i, ranks in got.items():
        s = np.round(unit @ unit[i], 9)
        want = sorted(range(len(v)), key=lambda j: (-s[j], len(v) - j))[:5]
        assert [ranks[k] for k in range(1, 6)] == want
    assert len(got) == 9


def test_ann_with_all_lists_is_exact(spark):
    _, q, c = vectors(spark)
    exact = {tuple(r) for r in E.knn_topk(q, c, 5).collect()}
    assert {tuple(r) for r in E.ann_topk(q, c, 5, lists=6, probes=6, query_block=4, corpus_block=5).collect()} == exact


def test_ann_reaches_its_recall(spark):
    v = np.random.default_rng(3).normal(size=(1500, 32)).astype("float32")
    c = spark.createDataFrame([(i, i, x.tolist()) for i, x in enumerate(v)], "row_id long, sort_key long, embedding array<float>")
    q = c.where("row_id % 10 = 0").selectExpr("row_id AS query_id", "embedding")
    assert E.ann_recall(E.knn_topk(q, c, 10), E.ann_topk(q, c, 10)).first().recall >= 0.9
    assert E.ann_topk(q, c.where("false"), 10).count() == 0 and E.ann_topk(q.where("false"), c, 10).count() == 0


def test_ann_of_clustered_vectors_scans_under_a_quarter(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(40, 32))[rng.integers(40, size=4000)] + 0.3 * rng.normal(size=(4000, 32))
    v[:1300] = v[0]  # a third of all rows is one vector
    rows = [(i, i, x.tolist()) for i, x in enumerate(v.astype("float32"))]
    c = spark.createDataFrame([*rows, (9999, 9999, None)], "row_id long, sort_key long, embedding array<float>")
    q = c.where("row_id % 9 = 0").selectExpr("row_id AS query_id", "embedding")
    search = E.ann_prepare(q, c, 10)
    found = E.ann_topk(q, c, 10, prepared=search, query_block=100, corpus_block=300)
    assert E.ann_recall(E.knn_topk(q.where("embedding IS NOT NULL"), c.where("embedding IS NOT NULL"), 10), found).first().recall >= 0.9
    asked = I.probed(search.index, q, search.probes)
    assert search.index.rows.count() == 4000  # every row is indexed
    assert I.compared_pairs(search.index, asked).first().compared < (q.count() - 1) * 4000 / 4
    plain = {(r.query_id, r.row_id): r.score for r in E.knn_topk(q.where("embedding IS NOT NULL"), c.where("embedding IS NOT NULL"), 10).collect()}
    assert all(plain[key] == r.score for r in found.collect() if (key := (r.query_id, r.row_id)) in plain)


def test_merge_in_a_tree_equals_one_merge(spark):
    _, q, c = vectors(spark)
    want = {tuple(r) for r in E.knn_topk(q, c, 5).collect()}
    assert {tuple(r) for r in E.knn_topk(q, c, 5, 4, 1).collect()} == want  # 60 lists, more than one level


def test_registered_recall_measures_the_registered_search(spark):
    from termweave.catalog import QUERIES

    sf = "/root/testdata/sf0.01"
    exact, found = ({(r.query_id, r.row_id) for r in QUERIES[n](spark, sf).collect()} for n in ("knn_topk", "ann_topk"))
    row = QUERIES["ann_recall"](spark, sf).first()
    assert (row.neighbours, row.found) == (len(exact), len(exact & found)) and row.recall >= 0.9


def test_encoder_contract(spark):
    rows = spark.createDataFrame([("code", i, f"text {i}") for i in range(130)], "source string, row_id long, text string")
    made = E.embed_batches(rows, "m", E.hashing_encoder(16), 16).collect()
    assert len(made) == 130 and all(abs(sum(x * x for x in r.embedding) - 1) < 1e-5 for r in made)
    with pytest.raises(Exception, match="dimension"):
        E.embed_batches(rows, "m", E.hashing_encoder(16), 32).collect()
    with pytest.raises(Exception, match="vectors for"):
        E.embed_batches(rows, "m", lambda: lambda texts: [[0.0] * 16], 16).collect()


def test_exact_search_copies_no_vectors_and_merges_few_lists(spark):
    """F1, F3, F10, F11. Neither side is repeated in an exchange, and a query leaves no more lists than tasks need."""
    rng = np.random.default_rng(9)
    v = rng.normal(size=(900, 8)).round(1).astype("float32")  # with equal scores
    v[::7] = 0
    c = spark.createDataFrame([(f"r{i % 800}", None if i % 5 == 0 else i % 50, x.tolist()) for i, x in enumerate(v)], "row_id string, sort_key long, embedding array<float>")
    q = spark.createDataFrame([(f"q{i % 30}", v[i].tolist()) for i in range(40)], "query_id string, embedding array<float>")  # ids repeat
    out = E.knn_topk(q, c, 6, 16, 20)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "CoGroup" not in plan
    assert plan.count("RepartitionByExpression") == 2  # a single placing of either side
    unit = v.astype(float) / np.where((n := np.linalg.norm(v.astype(float), axis=1, keepdims=True)) == 0, 1, n)
    got = {}
    for r in out.collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.score, r.sort_key, r.row_id))
    for name in {f"q{i}" for i in range(30)}:
        mine = [i for i in range(40) if f"q{i % 30}" == name]
        pool = [(-np.round(unit[i] @ unit[j], 9) + 0.0, (j % 5 != 0, j % 50), f"r{j % 800}") for i in mine for j in range(900)]
        assert [-s for _, s, _, _ in sorted(got[name])] == pytest.approx([x[0] for x in sorted(pool)[:6]])
    assert E.knn_topk(q, c.where("false"), 6).count() == 0 and E.knn_topk(q.where("false"), c, 6).count() == 0
    with pytest.raises(Exception, match="vector"):
        E.knn_topk(q, c.unionByName(spark.createDataFrame([("x", 1, None)], c.schema)), 6).collect()
