from pyspark.sql import functions as F

from termweave.operators import evaluate as EV


def test_gold_rank_sees_variants_and_families(spark):
    queries = spark.createDataFrame([(1, ["S72.92XA"]), (2, ["K35"]), (3, ["K35.31"]), (4, ["Q00"])], "query_id int, gold array<string>")
    hits = spark.createDataFrame(
        [(1, 1, "A00", []), (1, 2, "S72.92XD", ["S72.92XA"]), (2, 3, "K35.30", []), (3, 5, "K35.80", [])],
        "query_id int, rank int, code string, variants array<string>")
    got = {r.query_id: (r["rank"], r.family_rank) for r in EV.gold_rank(queries, hits).collect()}
    assert got == {1: (2, 2), 2: (3, 3), 3: (None, 5), 4: (None, None)}
    lists = EV.gold_rank(queries, hits.withColumn("mode", F.lit("text")), [{"mode": "text"}, {"mode": "hybrid"}])
    assert lists.count() == 8 and lists.where("mode = 'hybrid' and rank is not null").count() == 0


def test_summary_percentiles(spark):
    rows = [("c", float(i), i if i % 2 else None, None) for i in range(1, 12)]
    df = spark.createDataFrame(rows, "config string, latency_ms double, rank int, family_rank int")
    r = EV.summarise(df, ["config"]).first()
    assert (r.n, r.p50_ms, r.p95_ms) == (11, 6.0, 11.0)  # round-half-even(9.5) = 10 -> the 11th value
    assert abs(r.r_at_5 - 3 / 11) < 1e-12 and abs(r.mrr - (1 + 1 / 3 + 1 / 5 + 1 / 7 + 1 / 9 + 1 / 11) / 11) < 1e-12


def test_perturbations(spark):
    q = spark.createDataFrame([(i, t) for i, t in enumerate(["fracture of left femur", "of an arm", "open wound with infection", "scalp"])], "query_id int, query string")
    for r in EV.perturb_typo(q, 1).collect():
        a, b = r.original.split(), r.query.split()
        assert len(a) == len(b) and sum(x != y for x, y in zip(a, b)) <= 1
    shuffled = EV.perturb_shuffle(q, 1).collect()
    assert {r.query_id for r in shuffled} == {0, 2}
    for r in shuffled:
        kept = [w for w in r.original.split() if w not in EV.CONNECTIVES]
        assert sorted(r.query.split()) == sorted(kept) and r.query.split() != kept


def test_overlap(spark):
    df = spark.createDataFrame([("acute acute pain", "Acute thing"), ("the of", "x")], "query string, target string")
    got = [(round(r.overlap, 4), r.overlap_bucket) for r in EV.lexical_overlap(df).collect()]
    assert got == [(0.6667, "partial"), (0.0, "low")]


def test_a_list_that_answers_nothing_has_a_row(spark):
    queries = spark.createDataFrame([(1,), (2,)], "query_id int")
    hits = spark.createDataFrame([(1, "a")], "query_id int, list string")
    got = {r["list"]: (r.answered, r.empty) for r in EV.empty_result_rate(queries, hits, [{"list": "a"}, {"list": "b"}]).collect()}
    assert got == {"a": (1, 1), "b": (0, 2)}
