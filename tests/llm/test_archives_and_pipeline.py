"""WARC archives, the registered queries and the pipeline."""

import base64
import hashlib

import pytest
from pyspark.sql import types as T

import corpus_pipeline
from termweave.llm import queries, warc

from .conftest import odd_rows

PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()), T.StructField("digest", T.StringType()), T.StructField("first", T.LongType())])


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


@pytest.fixture(scope="module")
def pages(spark):
    bodies = ["<p>one</p>", "<p>two\r\n\r\nlines</p>", "<p>one</p>", None, "", "WARC/1.1\r\nWARC-Type: response\r\n\r\n", "é中🙂", "<p>one</p>", "x" * 200_000, "x" * 200_000]
    rows = [(10 - k, f"http://a.example/{k} b\r\nX: y" if k % 2 else None, t, "d", 1) for k, t in enumerate(bodies)] + [(None, "http://n.example/", "<p>one</p>", "d", 2)]
    return rows, spark.createDataFrame(rows, PAGES)


@pytest.mark.parametrize("least", [0, 5])
def test_archives_come_back(spark, pages, tmp_path, least):
    rows, table = pages
    path = str(tmp_path / "archives")
    warc.write_archives(warc.records(table, least_bytes=least), path, archive_bytes=100_000, size=500_000)
    got = {r["page_id"]: r for r in warc.read_archives(spark, path).collect()}
    assert len(got) == len(rows)
    payloads = {i: (t or "").encode() for i, _, t, *_ in rows}
    for i, payload in payloads.items():
        equal = [k for k, p in payloads.items() if k is not None and p == payload]
        first = min(equal) if len(payload) >= least and equal else i
        revisit = first != i
        r = got[i]
        assert (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) == (len(payload), digest(payload), "revisit" if revisit else "response", first if revisit else None)
        assert r["payload"] == (None if revisit else payload)


def test_archive_text_is_warc(pages):
    _, table = pages
    values = [r["value"] for r in warc.records(table).collect()]
    for value in values:
        head, _, block = value.partition("\r\n\r\n")
        lines = head.split("\r\n")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        assert lines[0] == "WARC/1.1" and int(fields["Content-Length"]) == len(block.encode()) and " " not in fields["WARC-Target-URI"]
        assert ("WARC-Refers-To" in fields) == (fields["WARC-Type"] == "revisit")


def test_no_pages(spark):
    assert warc.archived(spark.createDataFrame([], PAGES)).count() == 0


def test_damaged_payload_is_an_error():
    record = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nWARC-Payload-Digest: sha1:AAAA\r\nContent-Length: 40\r\n\r\nHTTP/1.1 200 OK\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    with pytest.raises(ValueError):
        list(warc._cut(record))


def test_queries_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert {n[:4].rstrip("_") for n in queries.ORACLES} == {"op2", "op5", "op9", "op10", "op11", "op12", "op13"}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "repeated_passages", "benchmark_leaks", "byte_bpe"]


def test_pipeline_on_odd_rows(spark, odd, none, sf, tmp_path):
    """Every stage takes what the one before kept; all but the last keep the columns."""
    docs = odd
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert after.columns == odd.columns and after.count() <= docs.count()
        docs = after
    # the copies 1, 2, 7 are one document; null, blank and short texts fail the rules
    assert {r["doc_id"] for r in docs.collect()} == {None, 1, 6, 8, 9, 10}
    docs = none
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0
    assert len(odd_rows()) == odd.count()


def test_pipeline_runs_whole(spark, sf):
    rows = corpus_pipeline.run(spark, sf).collect()
    ids = [r["doc_id"] for r in rows]
    assert 0 < len(ids) == len(set(ids)) < spark.read.parquet(f"{sf}/documents.parquet").count()
