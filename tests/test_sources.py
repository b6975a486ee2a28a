import io
import zipfile

import pytest

from termweave.operators import indexterms as IX
from termweave.sources import release as RL
from termweave.sources import tables as TB

TABULAR = b"""<?xml version="1.0"?><X><version>2030</version><chapter><diag><name>Q10.1</name>
<excludes1><note> other thing (Q10.2-) </note></excludes1>
<diag><name>Q10.11</name><inclusionTerm><note>Odd thing NOS</note></inclusionTerm></diag></diag>
<diag><name>Q11.0</name><sevenChrDef><extension char="A">first</extension><extension char="D">next</extension></sevenChrDef></diag>
<diag><name>Q12</name><desc>plain</desc></diag></chapter></X>"""

INDEX = b"""<X><version>2030</version><letter><mainTerm><title>Infarct, infarction<nemod> (old)</nemod></title><code>I21.9</code>
<term level="1"><title>myocardium, myocardial NOS</title><code>I21.-</code></term></mainTerm>
<mainTerm><title>Attack</title><term level="1"><title>heart</title><see>Infarct, myocardium</see></term>
<term level="1"><title>odd</title><see>condition</see></term></mainTerm></letter></X>"""


def members(spark, content):
    return spark.createDataFrame([("f.xml", "f.xml", bytearray(content))], "path string, member string, content binary")


def test_order_lines(spark):
    line = f"{'00012'} {'Q1011':7} 1 {'Short':60} A long text"
    rows = [("﻿" + line,), ("",), ("not a record",), (f"00013 {'Q10':7} 0 {'Head':60}\r",)]
    got = RL.order_records(spark.createDataFrame(rows, "value string")).collect()
    assert [(r.sort_order, r.code, r.is_billable, r.short_display, r.display) for r in got] == [
        (12, "Q10.11", True, "Short", "A long text"), (13, "Q10", False, "Head", "Head")]


def test_tabular_direct_children_only(spark):
    got = {r.code: (r.synonyms, r.notes) for r in RL.tabular_entries(RL.read_tabular_xml(members(spark, TABULAR))).collect()}
    assert got == {"Q10.1": ([], {"excludes1": ["other thing (Q10.2-)"]}), "Q10.11": (["Odd thing NOS"], {}),
                   "Q11.0": ([], {"seventh_character": ["A: first", "D: next"]})}


def test_index_terms(spark):
    nodes = RL.read_index_xml(members(spark, INDEX))
    direct = [(r.term, r.code, r.depth) for r in IX.direct_terms(nodes).orderBy("ordinal").collect()]
    assert direct == [("Infarct, infarction", "I21.9", 0), ("Infarct, infarction myocardium, myocardial", "I21", 1)]
    see = [(r.term, r.code, r.via_see) for r in IX.resolve_see(nodes, IX.path_aliases(nodes)).collect()]
    assert see == [("Attack heart", "I21", True)]


def test_holdout_is_stable_under_case_and_commas(spark):
    df = spark.createDataFrame([("Attack, heart",), ("attack  HEART",)], "term string")
    held = [r.held_out for r in IX.holdout_split(df, 50).collect()]
    assert held[0] == held[1]
    assert not any(r.held_out for r in IX.holdout_split(df, 0).collect())


def test_zip_members(spark):
    def packed(name):
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w") as z:
            z.writestr("readme.txt", "x")
            z.writestr(name, TABULAR)
        return spark.createDataFrame([("a.zip", bytearray(buffer.getvalue()))], "path string, content binary")

    assert RL.read_zip_member(packed("t/icd10cm-tabular-2030.xml"), RL.TABULAR_MEMBER).first().member == "t/icd10cm-tabular-2030.xml"
    with pytest.raises(Exception, match="no member"):
        RL.read_zip_member(packed("other.xml"), RL.TABULAR_MEMBER).collect()


def test_replace_leaves_other_releases(spark, tmp_path):
    path = str(tmp_path / "t")
    schema = "canonical_url string, version string, code string"
    TB.replace_release(spark.createDataFrame([("u", "1", "A"), ("u", "2", "B")], schema), path, "code")
    TB.replace_release(spark.createDataFrame([("u", "2", "C")], schema), path, "code")
    assert sorted(r.code for r in spark.read.parquet(path).collect()) == ["A", "C"]


def test_a_load_that_fails_between_two_tables_leaves_the_old_release(spark, tmp_path):
    path, schema = str(tmp_path / "published"), "canonical_url string, version string, code string"

    def rows(*some):
        return spark.createDataFrame(some, schema)

    def seen():
        return {n: sorted((r.version, r.code) for r in TB.read_release(spark, path, n, rows().schema).collect()) for n in ("concepts", "terms")}

    assert seen() == {"concepts": [], "terms": []}
    TB.publish_release({"concepts": (rows(("u", "01", "A"), ("u", "2", "B")), "code"), "terms": (rows(("u", "01", "a"), ("u", "2", "b")), "code")}, path, 1)
    before = {"concepts": [("01", "A"), ("2", "B")], "terms": [("01", "a"), ("2", "b")]}
    assert seen() == before
    broken = rows(("u", "2", "c")).selectExpr("canonical_url", "version", "CAST(raise_error('disk full') AS STRING) AS code")
    with pytest.raises(Exception, match="disk full"):
        TB.publish_release({"concepts": (rows(("u", "2", "C")), "code"), "terms": (broken, "code")}, path, 2)
    assert seen() == before
    TB.publish_release({"concepts": (rows(("u", "2", "D")), "code"), "terms": (rows(("u", "2", "d")), "code")}, path, 2)
    assert seen() == {"concepts": [("01", "A"), ("2", "D")], "terms": [("01", "a"), ("2", "d")]}
    with pytest.raises(ValueError, match="not above"):
        TB.publish_release({"concepts": (rows(("u", "2", "E")), "code")}, path, 2)


def test_release_errors(spark):
    order = spark.createDataFrame([("2030", "Q10")], "version string, code string")
    tabular = spark.createDataFrame([("2031", "Q10")], "version string, code string")
    index = spark.createDataFrame([("2030",)], "version string")
    with pytest.raises(ValueError, match="differ"):
        TB.raise_on_errors(TB.check_release(order, tabular, index, index))


def test_last_filled_list_and_last_diag_count(spark):
    text = b"""<X><version>2030</version><diag><name>Q11.0</name>
<sevenChrDef><extension char="A">first</extension></sevenChrDef><sevenChrDef><extension char="B"> </extension></sevenChrDef></diag>
<diag><name>Q12</name><includes><note>old</note></includes></diag><diag><name>Q12</name><includes><note>new</note></includes></diag></X>"""
    got = {r.code: (r.synonyms, r.notes) for r in RL.tabular_entries(RL.read_tabular_xml(members(spark, text))).collect()}
    assert got == {"Q11.0": ([], {"seventh_character": ["A: first"]}), "Q12": (["new"], {})}


def test_upsert_takes_the_latest_of_repeated_rows(spark):
    columns = "canonical_url string, version string, name string, title string, publisher string, updated_at long"
    incoming = spark.createDataFrame([("u", "1", "n", "old", "p", 1), ("u", "1", "n", "new", "p", 2)], columns)
    stored = spark.createDataFrame([], "id long, " + columns.replace("updated_at long", "active boolean, created_at long, updated_at long"))
    rows = TB.upsert_code_system(stored, incoming).collect()
    assert [(r.title, r.updated_at) for r in rows] == [("new", 2)]


def test_first_of_repeated_keys_is_stored(spark):
    incoming = spark.createDataFrame([("k", "b"), ("k", "a"), ("s", "x")], "key string, v string")
    stored = spark.createDataFrame([("s", "y")], "key string, v string")
    assert [tuple(r) for r in TB.append_if_absent(stored, incoming, ["key"]).collect()] == [("k", "a")]
