import json
import random

import pytest
from pyspark.sql import functions as F

from termweave.operators import coding as C
from termweave.operators import review as RV
from termweave.plans import intake


def lines(spark, docs):
    return spark.createDataFrame([(json.dumps(d) if not isinstance(d, str) else d,) for d in docs], "value string")


GOOD = {"encounter_id": "e1", "patient_id": "p", "soap_note": "n", "conditions": [{"text": "a", "details": {"x": 1}}],
        "medication_requests": [{"text": "m"}], "observations": [{"text": "o"}]}


def test_validation_rules(spark):
    docs = [GOOD, {**GOOD, "extra": 1}, {**GOOD, "conditions": [{"text": "a", "odd": "b"}]}, {**GOOD, "soap_note": ""},
            {**GOOD, "conditions": [{"text": "x" * 501}]}, {"encounter_id": "e", "patient_id": "p", "soap_note": "n"}, "not json",
            {**GOOD, "patient_id": "p" * 101}, {**GOOD, "department": "d" * 201}]
    got = [r.violations for r in C.validate_encounters(lines(spark, docs)).collect()]
    assert got[0] == []
    assert got[1] == ["unknown field extra"] and got[2] == ["unknown item field"] and got[3] == ["soap_note length"]
    assert got[4] == ["item text length"] and got[5] == ["no items"] and "not a JSON object" in got[6]
    assert got[7] == ["patient_id length"] and got[8] == ["department length"]


def test_items_in_order(spark):
    items = C.flatten_items(C.accepted(C.validate_encounters(lines(spark, [GOOD])))).orderBy("sequence").collect()
    assert [(r.sequence, r.item_type, r.text, r.status) for r in items] == [
        (1, "condition", "a", "pending"), (2, "observation", "o", "not_coded"), (3, "medication_request", "m", "not_coded")]
    assert json.loads(items[0].details) == {"x": 1}


def scored_items(n=60):
    """Random items: offered codes in search order, scores of some of them and of strangers, a "none" score or null."""
    rng = random.Random(19)
    for item in range(n):
        offered = [f"K{c}" for c in rng.sample(range(40), rng.randint(0, 6))]
        known = {c: rng.choice([0.0, 0.05, 0.3, 0.8, round(rng.random(), 3)]) for c in offered if rng.random() < 0.8}
        yield item, offered, known, rng.choice([None, 0.0, 0.05, 0.3, round(rng.random(), 3)])


def test_rank_and_assign_equal_a_plain_formulation(spark):
    cases = list(scored_items())
    offered = [(i, c, at) for i, codes, _, _ in cases for at, c in enumerate(codes, 1)]
    said = [(i, c, p) for i, _, known, _ in cases for c, p in known.items()]
    ranked = C.rank_scores(
        spark.createDataFrame(offered, "item_id int, code string, search_rank int"),
        spark.createDataFrame(said, "item_id int, code string, probability double"),
        spark.createDataFrame([(i, n) for i, _, _, n in cases], "item_id int, nota_probability double"),
    )
    lists = {}
    for r in ranked.orderBy("item_id", "rank").collect():
        lists.setdefault(r.item_id, []).append((r.code, r.probability))
    assigned = {r.item_id: r for r in C.assign(ranked, low=0.5, nota=0.25).collect()}
    for item, codes, known, nota in cases:
        nota = nota or 0.0
        want = sorted([*((c, known.get(c, 0.0)) for c in codes), (None, nota)], key=lambda x: -x[1])  # stable: search order, then none
        assert lists[item] == want
        real = [x for x in want if x[0] is not None]
        flags = ["LOW_CONFIDENCE"] * bool(real and real[0][1] < 0.5)
        flags += ["NONE_OF_THE_ABOVE"] * bool(real and (nota >= 0.25 or (want[0][0] is None and nota > 0)))
        got = assigned[item]
        assert (got.assigned_code, got.flags) == ((real[0][0], flags) if real else (None, ["NO_CANDIDATES"]))


def test_queue_and_status_of_every_mix_of_items(spark):
    kinds = [("not_coded", []), ("scored", []), ("scored", ["F1"]), ("no_candidates", ["F2"]), ("failed", ["F3"])]
    mixes = {f"m{bits}": [k for n, k in enumerate(kinds) if bits >> n & 1] for bits in range(1, 32)}
    rows = [(m, *k) for m, some in mixes.items() for k in some]
    got = C.review_queue(spark.createDataFrame(rows, "encounter_id string, status string, flags array<string>")).collect()
    assert len(got) == 31
    for r in got:
        coded = [k for k in mixes[r.encounter_id] if k[0] != "not_coded"]
        assert (r.review_queue == "close_review") == any(flags for _, flags in coded)
        assert (r.status == "failed") == (bool(coded) and all(status == "failed" for status, _ in coded))


ITEMS = "encounter_id string, item_id int, sequence int, item_type string, coded boolean, status string, final_code string"


def test_approval_result_and_payloads(spark):
    rows = [("a", 1, 2, "condition", True, "overridden", "Z"), ("a", 2, 1, "condition", True, "approved", "Y"), ("a", 3, 3, "condition", True, "removed", None),
            ("a", 4, 4, "observation", False, "not_coded", None), ("b", 5, 1, "condition", True, "approved", "Y"), ("b", 6, 2, "condition", True, "failed", None),
            ("c", 7, 1, "condition", True, "approved", "X")]
    items = spark.createDataFrame(rows, ITEMS)
    heads = spark.createDataFrame([("a", False), ("b", False), ("c", True), ("none", False)], "encounter_id string, is_human_reviewed boolean")
    got = {r.encounter_id: (r.allowed, r.unresolved, r.billed) for r in RV.approve_encounters(heads, items).collect()}
    assert got == {"a": (True, 0, 2), "b": (False, 1, 1), "c": (False, 0, 1), "none": (True, 0, 0)}
    out = [tuple(r) for r in RV.approval_items(heads, items).orderBy("encounter_id", "sequence").collect()]
    assert out == [("a", True, 1, 2, "approved", "Y"), ("a", True, 2, 1, "overridden", "Z"), ("b", False, 2, 6, "failed", None)]

    events = [("a", 1, 1, "scored", "Q"), ("a", 2, 2, "scored", "Y"), ("a", 3, 3, "scored", "Q"), ("a", 1, 4, "approve", None), ("a", 1, 5, "override", "Z"),
              ("a", 2, 6, "approve", None), ("a", 3, 7, "remove", None), ("a", None, 8, "encounter.approve", None)]
    told = spark.createDataFrame([(*e, "who") for e in events], "encounter_id string, item_id int, seq int, kind string, code string, actor string")
    some = items.where("encounter_id = 'a'")
    replayed = RV.apply_reviews(some, told, spark.createDataFrame([("Z",)], "code string"), spark.createDataFrame([(1, "Q")], "item_id int, code string"))
    routed = spark.createDataFrame([("a", "ready_for_review", "standard")], "encounter_id string, status string, review_queue string")
    none = spark.createDataFrame([], "encounter_id string, item_id int, kind string, payload string")
    trail = RV.audit_trail(RV.audit_events(some, none, replayed, routed), routed).orderBy("position").collect()
    parsed = [(r.action, r.item_id, r.before and json.loads(r.before), json.loads(r.after)) for r in trail]
    assert parsed[0] == ("encounter.received", None, None, {"items": {"condition": 3, "observation": 1}, "coded_item_types": ["condition"]})
    assert parsed[2] == ("item.approve", 1, {"status": "scored", "final_code": None, "assigned_code": "Q"}, {"final_code": "Q"})
    assert parsed[3] == ("item.override", 1, {"status": "approved", "final_code": "Q", "assigned_code": "Q"}, {"final_code": "Z", "in_candidates": False})
    assert parsed[-1] == ("encounter.approved", None, None, {"final_billing_codes": ["Y", "Z"]})


def test_record_pages(spark):
    rows = [("e", i, 5 - i, "condition", f"t{i}", None, "scored" if i else "failed", None if i else "broke", f"C{i}" if i else None, "d", 0.5, None, [], None, None, None, None, None) for i in range(5)]
    items = spark.createDataFrame(rows, """encounter_id string, item_id int, sequence int, item_type string, text string, details string, status string, error string,
        assigned_code string, assigned_display string, probability double, nota_probability double, flags array<string>, final_code string, final_display string,
        review_action string, reviewed_by string, reviewed_at timestamp""")
    heads = spark.createDataFrame([("e", "p", "n", None, "s", "q", False, None, None, None), ("bare", "p", "n", "d", "s", "q", True, "r", None, None)],
        """encounter_id string, patient_id string, soap_note string, department string, status string, review_queue string, is_human_reviewed boolean,
        reviewed_by string, reviewed_at timestamp, created_at timestamp""")
    made = spark.createDataFrame([(i, "succeeded" if i else "failed", "x", "m", 1.26, 2) for i in range(5)], "item_id int, status string, engine string, model string, latency_ms double, candidates_scored int")
    other = spark.createDataFrame([(1, 2, "B", "b", 0.1, 3, None), (1, 1, "A", "a", 0.2, 1, "syn")], "item_id int, place int, code string, display string, probability double, search_rank int, matched_on string")
    got = {(r.encounter_id, r.page): r for r in RV.encounter_record(heads, items, made, other, page_size=2).collect()}
    assert set(got) == {("e", 0), ("e", 1), ("e", 2), ("bare", 0)}
    assert [[i.item_id for i in got["e", n].coded_concepts] for n in range(3)] == [[4, 3], [2, 1], [0]]
    assert got["e", 0].audit_trail.final_billing_codes == ["C4", "C3"] and got["e", 2].audit_trail.final_billing_codes == []
    one = got["e", 1].coded_concepts[1]
    assert [a.code for a in one.ai_classification.top_alternatives] == ["A", "B"] and one.ai_classification.latency_ms == 1.3
    failed = got["e", 2].coded_concepts[0]
    assert failed.ai_classification is None and failed.error == "broke"
    assert not got["bare", 0].coded_concepts and got["bare", 0].audit_trail.final_billing_codes == [] and got["bare", 0].clinical_input.department == "d"


def test_one_failed_search_does_not_sink_the_batch(spark, sf):
    from termweave.catalog import views as V

    def factory():
        plain = V.ENCODER()

        def encode(texts):
            if any("explode" in t for t in texts):
                raise RuntimeError("remote refused")
            return plain(texts)

        return encode

    def scorer():
        def score(note, text, options):
            if text.startswith("large"):
                raise ValueError("no answer")
            return {"model": "m", "probabilities": {o["code"]: 0.9 if o["search_rank"] == 1 else 0.0 for o in options}, "nota_probability": 0.1}

        return score

    def doc(number, *texts):
        return {"encounter_id": f"e{number}", "patient_id": "p", "soap_note": "n", "conditions": [{"text": t} for t in texts], "observations": [{"text": "o"}]}

    term = V.eval_queries(spark, sf).orderBy("query").first().query
    docs = [doc(1, "explode now"), doc(2, term, "explode now"), doc(3, term), doc(4, "large " + term)]
    out = intake.code_encounters(lines(spark, docs), V.release(spark, sf), factory, V.MODEL, V.DIMENSIONS, {"x": scorer}, "x")
    items = {(r.encounter_id, r.sequence): r for r in out.items.collect()}
    assert {k: r.status for k, r in items.items()} == {
        ("e1", 1): "failed", ("e1", 2): "not_coded", ("e2", 1): "scored", ("e2", 2): "failed", ("e2", 3): "not_coded",
        ("e3", 1): "scored", ("e3", 2): "not_coded", ("e4", 1): "failed", ("e4", 2): "not_coded"}
    assert items["e1", 1].error == "RuntimeError: remote refused" and items["e1", 1].flags == ["SCORING_FAILED"] and "no answer" in items["e4", 1].error
    assert items["e3", 1].error is None and items["e3", 1].assigned_code
    assert {r.encounter_id: (r.status, r.review_queue) for r in out.encounters.collect()} == {
        "e1": ("failed", "close_review"), "e2": ("ready_for_review", "close_review"), "e3": ("ready_for_review", "standard"), "e4": ("failed", "close_review")}
    events = sorted((r.encounter_id, r.action) for r in out.events.collect())
    coded = {"e1": ["item.failed"], "e2": ["item.failed", "item.scored"], "e3": ["item.scored"], "e4": ["item.scoring_failed"]}
    assert events == sorted((e, a) for e, some in coded.items() for a in ["encounter.received", "encounter.processed", *some])


def test_scorers(spark):
    candidates = spark.createDataFrame([(i, f"C{r}", f"d{r}", r) for i in (1, 2) for r in (3, 1, 2)], "item_id int, code string, display string, search_rank int")
    sums = C.score_search_rank(candidates).groupBy("item_id").agg(F.sum("probability").alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-9 for r in sums)
    items = spark.createDataFrame([(1, "boom", "n"), (2, "ok", "n"), (3, "no candidates", "n")], "item_id int, text string, note string")

    def broken():
        def score(note, text, options):
            if text == "boom":
                raise RuntimeError("exploded")
            return {"model": "halving", "probabilities": {o["code"]: 0.5 ** o["search_rank"] for o in options}}
        return score

    made = {r.item_id: r for r in C.score_with(items, candidates, {"x": broken}, "x").collect()}
    assert set(made) == {1, 2} and made[1].status == "failed" and "exploded" in made[1].error
    assert made[2].status == "succeeded" and made[2].probabilities[0].code == "C1"
    with pytest.raises(ValueError, match="unknown decision engine"):
        C.score_with(items, candidates, {"x": broken}, "y")


def test_built_in_engine_and_repeats(spark):
    candidates = spark.createDataFrame([(1, "C1", 1), (1, "C2", 2), (2, "C3", 1)], "item_id int, code string, search_rank int")
    made = C.decide_by_rank(spark.createDataFrame([(1,)], "item_id int"), candidates).collect()
    assert len(made) == 1 and made[0].status == "succeeded"
    assert {p.code for p in made[0].probabilities} == {"C1", "C2"} and abs(sum(p.probability for p in made[0].probabilities) - 1) < 1e-9

    rows = [("b", "x", []), ("a", "x", []), ("a", "x", []), ("c", "y", []), ("d", "z", ["bad"]), ("e", "w", [])]
    checked = spark.createDataFrame(rows, "value string, id string, violations array<string>").select("value", F.struct(F.col("id").alias("encounter_id")).alias("e"), "violations")
    stored = spark.createDataFrame([("y",), ("y",)], "encounter_id string")
    got = sorted((r.value, tuple(r.violations)) for r in intake.refuse_repeats(checked, stored).collect())
    assert got == [("a", ()), ("a", ()), ("b", ("encounter id repeated in the batch",)), ("c", ("encounter id is stored already",)), ("d", ("bad",)), ("e", ())]


def test_mentions(spark):
    notes = spark.createDataFrame([("e", "Fever, high FEVER (a+b) and fever chills", ["fever", "fever chills", "a+b", "x"])], "encounter_id string, note string, texts array<string>")
    got = [(r.mention, r.start) for r in C.note_mentions(notes).orderBy("start").collect()]
    assert got == [("Fever", 0), ("FEVER", 12), ("a+b", 19), ("fever chills", 28)]


def brute_replay(events, coded, billable):
    """Events one after the other, as a reviewer's session would apply them."""
    items, closed, out = {}, False, []
    for e in events:
        kind, item, code = e["kind"], e["item_id"], e["code"]
        state = items.get(item)
        reason = None
        if closed:
            reason = "already approved"
        elif kind == RV.APPROVAL:
            open_ = [i for i, c in coded.items() if c and not (items.get(i) or {}).get("done")]
            reason = "items still need review" if open_ else None
        elif kind in RV.REVIEWS:
            if item not in coded:
                reason = "unknown item"
            elif not coded[item]:
                reason = "not coded"
            elif not state:
                reason = "pending"
            elif kind == "approve" and not state["assigned"]:
                reason = "nothing to approve"
            elif kind != "override" and code:
                reason = "code without override"
            elif kind == "override" and not code:
                reason = "override without code"
            elif kind == "override" and code not in billable:
                reason = "not billable"
        out.append(reason)
        if reason:
            continue
        if kind == RV.APPROVAL:
            closed = True
        elif kind in RV.SCORING:
            items[item] = {"assigned": code, "done": False}
        else:
            state["done"] = True
    return out


def test_replay_equals_one_by_one(spark):
    rng = random.Random(7)
    coded = {1: True, 2: True, 3: False}
    rows, want = [], {}
    for n in range(60):
        events = []
        for seq in range(rng.randrange(3, 16)):
            kind = rng.choice(["scored", "failed", "approve", "override", "remove", "approve", RV.APPROVAL, "override"])
            code = rng.choice([None, "A", "B", "Z"])
            if kind == "scored":
                code = "A"
            if kind in ("failed", RV.APPROVAL):
                code = None
            if kind in ("approve", "remove") and rng.random() < 0.8:
                code = None
            item = None if kind == RV.APPROVAL else n * 10 + rng.choice([1, 1, 2, 2, 3] + ([] if kind in RV.SCORING else [4]))
            events.append({"kind": kind, "item_id": item, "code": code})
        want[f"e{n}"] = brute_replay(events, {n * 10 + i: c for i, c in coded.items()}, {"A", "B"})
        rows += [(f"e{n}", e["item_id"], s, e["kind"], e["code"], "r") for s, e in enumerate(events)]
    items = spark.createDataFrame([(f"e{n}", n * 10 + i, c) for n in range(60) for i, c in coded.items()], "encounter_id string, item_id long, coded boolean")
    events = spark.createDataFrame(rows, "encounter_id string, item_id long, seq long, kind string, code string, actor string")
    billable = spark.createDataFrame([("A",), ("B",)], "code string")
    offered = spark.createDataFrame([(1, "A")], "item_id long, code string")
    got = {}
    for r in RV.apply_reviews(items, events, billable, offered).collect():
        got.setdefault(r.encounter_id, {})[r.seq] = r.reason
    for k, reasons in want.items():
        assert [got[k][i] for i in range(len(reasons))] == reasons, k


def test_override_codes_are_dotted_first(spark):
    items = spark.createDataFrame([("e", 1, True)], "encounter_id string, item_id int, coded boolean")
    rows = [("e", 1, 1, "scored", "Q10.1", "m"), ("e", 1, 2, "override", " q1012", "m"), ("e", 1, 3, "override", " ", "m")]
    events = spark.createDataFrame(rows, "encounter_id string, item_id int, seq int, kind string, code string, actor string")
    billable = spark.createDataFrame([("Q10.12",)], "code string")
    candidates = spark.createDataFrame([(1, "Q10.12")], "item_id int, code string")
    got = {r.seq: (r.accepted, r.reason, r.final_code, r.in_candidates) for r in RV.apply_reviews(items, events, billable, candidates).collect()}
    assert got[2] == (True, None, "Q10.12", True) and got[3][1] == "override without code"
