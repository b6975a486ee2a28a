from pyspark.sql import functions as F

from termweave.functions import codes as K
from termweave.operators import hierarchy as H
from termweave.operators import semantic as E

URL = "u"


def concept_rows(spark, codes, billable=lambda c: len(c) > 5):
    rows = [(URL, "1", i, c, f"d {c}", c, billable(c), i) for i, c in enumerate(codes)]
    return spark.createDataFrame(
        rows, "canonical_url string, version string, concept_id long, code string, display string, short_display string, is_billable boolean, sort_order int"
    )


def test_code_shapes(spark):
    rows = [("K35", "K35", True), ("k3530", "K35.30", True), ("S0100XA", "S01.00XA", True), ("k35.30", "K35.30", True),
            ("K35.", "K35", True), ("appendicitis", None, False), ("acute K35", None, False), ("35", None, False)]
    df = spark.createDataFrame(rows, "raw string, want string, shaped boolean")
    for r in df.select("*", K.to_dotted("raw").alias("got"), K.is_code_like(F.col("raw")).alias("like")).collect():
        assert r.like == r.shaped
        assert r.want is None or r.got == r.want


def test_prefix_and_stem(spark):
    df = spark.createDataFrame([("S72.9-",), ("A30.-",), ("K35.31",), ("S72.92XA",), ("I10",)], "c string")
    got = [tuple(r) for r in df.select(K.code_prefix(F.col("c")), K.variant_stem(F.col("c"))).collect()]
    assert got == [("S72.9", "S72.9-"), ("A30", "A30.-"), ("K35.31", "K35.31"), ("S72.92XA", "S72.92X"), ("I10", "I10")]


def test_parent_skips_missing_stems(spark):
    df = concept_rows(spark, ["K35", "K35.3", "K35.30", "S01", "S01.0", "S01.00", "S01.00XA"])
    got = {r.code: r.parent_code for r in H.derive_parent(df).collect()}
    assert got["K35.30"] == "K35.3" and got["K35.3"] == "K35" and got["K35"] is None and got["S01.00XA"] == "S01.00"


def test_expansion_stops_at_the_eleventh_stem(spark):
    codes = ["S72"] + [f"S72.{stem:02d}X{ext}" for stem in range(15) for ext in "AD"]
    kept = H.category_expansion(concept_rows(spark, codes)).where("category = 'S72'").collect()
    assert len({r.stem for r in kept}) == 10 and len(kept) == 20
    assert sorted(r.i for r in kept) == list(range(20))


def test_expansion_cut_is_a_stop_not_a_skip(spark):
    # The first stem comes back after the eleventh stem opened: that late variant is not reached.
    order = [f"S72.{stem:02d}XA" for stem in range(11)] + ["S72.00XD"]
    df = concept_rows(spark, ["S72"] + order)
    kept = [r.child_code for r in H.category_expansion(df).where("category = 'S72'").collect()]
    assert sorted(kept) == order[:10]


def test_embedding_text(spark):
    concepts = spark.createDataFrame([(1, "Fever"), (2, "Cholera"), (3, "Acute appendicitis")], "concept_id long, display string")
    names = spark.createDataFrame([(2, "cholera"), (3, "Ruptured appendix"), (3, "Perforated appendix"), (3, "")], "concept_id long, synonym string")
    got = {r.concept_id: r.text for r in E.embedding_text(concepts, names).collect()}
    assert got == {1: "Fever", 2: "Cholera", 3: "Acute appendicitis. Includes: Perforated appendix; Ruptured appendix"}
