"""Steps that cut or place rows before they are widened (findings of round 3)."""

import random

from pyspark.sql import functions as F

from termweave.operators import coding as C
from termweave.operators import evaluate as E
from termweave.operators import lexical as L
from termweave.operators import ranking as R
from termweave.operators import review as RV
from termweave.plans import ablation as A
from termweave.session import folded_join, materialise, spread


def bag(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_folded_join_equals_a_join(spark):
    """Repeated keys on both sides multiply, null keys meet nothing."""
    left = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (1, "b", 3), (2, None, 4), (None, "a", 5), (3, "c", None)], "i int, c string, x int")
    right = spark.createDataFrame([(1, "a", 7.0), (1, "a", 8.0), (3, "c", None), (2, None, 9.0), (4, "d", 1.0)], "i int, c string, y double")
    assert bag(folded_join(left, right, ["i", "c"])) == bag(left.join(right, ["i", "c"], "left"))
    assert bag(folded_join(left, right, ["i", "c"], "left_semi")) == bag(left.join(right, ["i", "c"], "left_semi"))
    keys = right.select("i", "c")
    assert bag(folded_join(left, keys, ["i", "c"], "left_semi")) == bag(left.join(keys, ["i", "c"], "left_semi"))


def test_placed_scores_are_ranked_where_they_stand(spark):
    offered = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "item_id int, code string, search_rank int")
    scores = spark.createDataFrame([(1, "b", 0.5), (1, "z", 0.4), (2, "c", 0.2)], "item_id int, code string, probability double")
    nota = spark.createDataFrame([(1, 0.1), (2, 0.3)], "item_id int, nota_probability double")
    offered, scores, nota = (spread(t, t, "item_id") for t in (offered, scores, nota))
    ranked = C.rank_scores(offered, C.closed_set_filter(scores, offered), nota)
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "ENSURE_REQUIREMENTS" not in plan
    got = {(r.item_id, r.code): (r.probability, r["rank"]) for r in ranked.collect()}
    assert got == {(1, "b"): (0.5, 1), (1, None): (0.1, 2), (1, "a"): (0.0, 3), (2, None): (0.3, 1), (2, "c"): (0.2, 2)}


def test_best_rows_attach_few_rows_of_many_copies(spark):
    """60 texts of up to 90 copies, scores with ties: the best rows of a plain sort, from a bounded number of rows."""
    rng = random.Random(5)
    rows, scored = [], []
    for d in range(60):
        keys = sorted(rng.sample(range(100_000), rng.choice([1, 3, 4, 17, 90])))
        for place, key in enumerate(keys, 1):
            rows.append((0, f"d{d}", key, key, key, f"t{key}", place))
        scored.append(("q", 0, f"d{d}", rng.choice([0.9, 0.5, 0.5, 0.1]), (keys[0], f"t{keys[0]}", keys[0])))
    rows = spark.createDataFrame(rows, "source int, doc_id string, row_id long, concept_id long, sort_key long, sort_text string, place int")
    scored = spark.createDataFrame(scored, "text_id string, source int, doc_id string, score double, first_row struct<sort_key:long,sort_text:string,row_id:long>")
    index = L.LexicalIndex(None, rows, None, None)
    scores = {r.doc_id: r.score for r in scored.collect()}
    for pool in (1, 5, 40, 200, 5000):
        best = sorted(((-scores[r.doc_id], r.sort_key) for r in rows.collect()))[:pool]
        got = [(-r.score, r.concept_id) for r in L._best_rows(scored, index, pool).orderBy("source_rank").collect()]
        assert got == best
        docs = scored.drop("first_row")
        attached = L._row_shares(docs, index, pool).agg(F.sum("upto")).first()[0]
        assert attached <= 8 * pool + 3 * 60


def test_reviews_of_no_item_or_no_code(spark):
    """Approvals and events without a code are replayed like others, and no join gathers them under a null key."""
    items = spark.createDataFrame([("e", 1, True), ("e", 2, True)], "encounter_id string, item_id long, coded boolean")
    events = spark.createDataFrame(
        [("e", 1, 1, "scored", "A"), ("e", 2, 2, "failed", None), ("e", None, 3, "encounter.approve", None), ("e", 1, 4, "approve", None),
         ("e", 2, 5, "override", "X"), ("e", 2, 6, "override", None), ("e", 2, 7, "override", "k351"), ("e", None, 8, "override", "K35.1"),
         ("e", 9, 9, "remove", None), ("e", None, 10, "encounter.approve", None), ("e", 1, 11, "remove", None)],
        "encounter_id string, item_id long, seq int, kind string, code string").withColumn("actor", F.lit("coder"))
    billable = spark.createDataFrame([("A",), ("K35.1",)], "code string")
    offered = spark.createDataFrame([(1, "A"), (2, "K35.1"), (2, "K35.1")], "item_id long, code string")
    events = RV.with_dotted_overrides(events)
    out = RV.apply_reviews(items, events, billable, offered)
    got = {r.seq: (r.reason, r.in_candidates, r.final_code) for r in out.collect()}
    assert len(got) == out.count() == 11
    assert got[3][0] == RV.NEEDS_REVIEW and got[5][0] == "not billable" and got[6][0] == "override without code"
    assert got[8][0] == "unknown item" and got[9][0] == "unknown item" and got[10][0] is None and got[11][0] == RV.ALREADY
    assert got[4] == (None, None, "A")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    on_code = [line for line in plan.splitlines() if "Join LeftOuter, (code" in line]
    assert len(on_code) == 1 and "override" in plan[plan.index(on_code[0]):]


def test_weights_rank_the_same_pairs(spark):
    """Pairs that are folded once and weighed three times equal three fusions."""
    rng = random.Random(3)
    schema = "query_id string, rank int, concept_id long, code string, sort_order long, score double, matched_on string, variants array<string>"

    def hits():
        return spark.createDataFrame(
            [(q, at, c, f"A{c:02}.0", c, 0.0, None, []) for q in "xyz" for at, c in enumerate(rng.sample(range(30), 12), 1)], schema)

    text, semantic = hits(), hits()
    weights = (1.5, 0.4, 0.0)
    grid = R.paired_hits(text, semantic).withColumn("weight", F.explode(F.array(*[F.lit(w) for w in weights])))
    weighed = R.weigh_pairs(grid, F.col("weight"), per=("weight", "query_id"))
    for w in weights:
        columns = ["query_id", "rank", "code", "variants", "text_rank", "semantic_rank", "score"]
        assert bag(weighed.where(F.col("weight") == w).select(*columns)) == bag(R.rrf_fuse(text, semantic, text_weight=w).select(*columns))


def test_placed_candidates_of_items_stay_where_they_are(spark):
    """F29. Repeated codes, an item without scores, null keys and codes; no exchange but the given placing."""
    offered = spark.createDataFrame(
        [(1, "a", 1, "x"), (1, "a", 2, None), (1, "b", 3, "y"), (2, None, 1, "z"), (None, "a", 1, "n"), (3, "c", 1, "w"), (9, "d", 1, "v")],
        "item_id int, code string, search_rank int, matched_on string")
    ranked = spark.createDataFrame([(1, "a", 0.5, 1), (1, "z", 0.4, 2), (1, None, 0.1, 3), (None, "a", 0.9, 1)], "item_id int, code string, probability double, rank int")
    items = spark.createDataFrame([(1, "a", "b"), (2, None, None), (3, None, "c"), (None, "a", "a")], "item_id int, assigned_code string, final_code string")
    placed = [spread(t, t, "item_id") for t in (items, offered, ranked)]
    out = RV.item_candidates(*placed)
    assert "ENSURE_REQUIREMENTS" not in out._jdf.queryExecution().executedPlan().toString()
    wanted = [
        (1, "a", 1, "x", 0.5, 1, True, False), (1, "a", 2, None, 0.5, 1, True, False), (1, "b", 3, "y", None, None, False, True),
        (2, None, 1, "z", None, None, False, False), (3, "c", 1, "w", None, None, False, True),
    ]
    assert bag(out) == sorted(wanted, key=repr)


def test_written_tables_leave_no_shuffle_files(spark):
    """F7, F9, F13. Nothing of a step's exchanges stays on disk beside its table; the session's setting is kept."""

    def held():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}

    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, held_before = spark.conf.get(setting, None), held()
    rows = spark.range(5000).selectExpr("id % 700 AS k", "id")
    summed = rows.groupBy("k").agg(F.sum("id").alias("s"))
    table = materialise(summed, "no-shuffles")
    assert held() <= held_before and spark.conf.get(setting, None) == before
    assert bag(table) == bag(summed) == bag(materialise(summed, "no-shuffles"))


def test_gold_is_compared_once_for_all_weights(spark):
    """F6. Flags equal the prefixes by hand, and no hit is repeated per code and prefix before it is ranked."""
    schema = "query_id string, rank int, concept_id long, code string, sort_order long, score double, matched_on string, variants array<string>"
    text = spark.createDataFrame([("x", 1, 1, "A01.1", 1, 0.0, None, []), ("x", 2, 2, "B02.3", 2, 0.0, None, ["B02.34", None]), ("x", 3, 3, None, 3, 0.0, None, []), ("y", 1, 4, "C", 4, 0.0, None, None)], schema)
    semantic = spark.createDataFrame([("x", 1, 5, "B02.9", 5, 0.0, None, []), ("x", 2, 1, "A01.1", 1, 0.0, None, []), (None, 1, 2, "B02.3", 2, 0.0, None, [])], schema)
    queries = spark.createDataFrame([("x", ["b0234"]), ("x", [None]), ("y", None), ("z", ["A01"])], "query_id string, gold array<string>")
    flags = {(r.query_id, r.code): (r._exact, r._family) for r in E.flag_gold(queries, text.unionByName(semantic)).collect()}
    assert flags == {("x", "A01.1"): (False, False), ("x", "B02.3"): (True, False), ("x", None): (False, False), ("y", "C"): (False, False), ("x", "B02.9"): (False, False), (None, "B02.3"): (False, False)}
    queries = queries.where("gold IS NULL OR gold[0] IS NOT NULL").replace("b0234", "B02.34").withColumn("gold", F.when(F.col("query_id") == "x", F.array(F.lit("B02.34"))).otherwise(F.col("gold")))
    one = {r.query_id: (r["rank"], r.family_rank) for r in E.gold_rank(queries, text).collect()}
    assert one == {"x": (2, 2), "y": (None, None), "z": (None, None)}
    flagged = E.gold_rank(queries, E.flag_gold(queries, text).drop("code", "variants"))
    assert {r.query_id: (r["rank"], r.family_rank) for r in flagged.collect()} == one
    tuned = A.tune_weight(queries, text, semantic, (1.0, 0.0))
    got = {r.list: (r.n, round(r.mrr, 6)) for r in tuned.collect()}
    assert got["text only"] == (3, round(1 / 2 / 3, 6)) and got["semantic only"] == (3, 0.0)
    assert got["hybrid 1.0"] == (3, round(1 / 3 / 3, 6))  # A01.1 is in both lists, B02.9 leads the other
