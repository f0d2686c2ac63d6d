"""Edits, sources and splits on small texts of known result."""

import json

import pytest
from pyspark.sql import functions as F

from quillspark.operators import edits, mining
from quillspark.sources import manifests


def test_fix_changes_only_what_it_edits(spark):
    texts = [
        "lower start stays. nothing here.",
        "Of the many ways one works. of the rest none.",
        'He said "of the many" and it is so.',
        "a part of the whole",
        "",
        None,
        "of the " + "x" * 300 + " end",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seams = spark.createDataFrame([("part", "whole")], "left string, right string")
    got = {r.doc_id: r.text for r in edits.fix(docs, ["of the"], {"it is": "that was"}, seams).collect()}
    assert got == {0: texts[0], 1: "Many ways one works. Rest none.", 2: 'He said "of the many" and that was so.', 3: "a part whole", 4: "", 5: None, 6: "X" + "x" * 299 + " end"}
    again = edits.fix(spark.createDataFrame(list(got.items()), "doc_id long, text string"), ["of the"], {"it is": "that was"}, seams)
    assert {r.doc_id: r.text for r in again.collect()} == got


def test_split_keeps_null_strata(spark):
    docs = spark.createDataFrame([(k, None if k % 3 else "en") for k in range(90)], "doc_id long, lang string")
    got = mining.split_assign(docs, ["lang"]).groupBy("lang", "split").count().collect()
    assert {(r.lang, r.split): r["count"] for r in got} == {("en", "train"): 21, ("en", "dev"): 4, ("en", "holdout"): 5, (None, "train"): 42, (None, "dev"): 9, (None, "holdout"): 9}


def test_sources(spark, tmp_path):
    (tmp_path / "texts").mkdir()
    (tmp_path / "texts" / "a.md").write_text("caf\u00e9\n")
    got = manifests.read_folder(spark, str(tmp_path / "texts")).collect()
    assert [r.text for r in got] == ["caf\u00e9\n"] and got[0].path.endswith("a.md")
    (tmp_path / "texts" / "b.md").write_bytes(b"\xff\xfe bad")
    with pytest.raises(Exception, match="not valid UTF-8"):
        manifests.read_folder(spark, str(tmp_path / "texts")).collect()
    (tmp_path / "b.jsonl").write_text('{"id": "1", "text": "x"}\n')
    assert manifests.read_bucket(spark, str(tmp_path / "b.jsonl")).select("id", "text").collect() == [("1", "x")]
    (tmp_path / "c.jsonl").write_text('{"id": "1", "text": \n')
    with pytest.raises(Exception, match="FAILFAST|[Mm]alformed"):
        manifests.read_bucket(spark, str(tmp_path / "c.jsonl")).collect()
    spans = spark.createDataFrame([(1, "a.md", 2, 3, "r", "m"), (2, "b.md", 1, 1, "q", "n"), (1, "a.md", 1, 5, "q", "n")], "doc_id long, uri string, line int, column int, rule string, message string")
    logs = {r.doc_id: json.loads(r.sarif) for r in manifests.sarif(spans).collect()}
    found = {i: [(x["ruleId"], x["locations"][0]["physicalLocation"]["artifactLocation"]["uri"]) for x in log["runs"][0]["results"]] for i, log in logs.items()}
    assert found == {1: [("q", "a.md"), ("r", "a.md")], 2: [("q", "b.md")]}
    df = spark.createDataFrame([("a.HTML", ""), ("b", "<!DOCTYPE html>"), ("c.md", "x")], "path string, text string")
    assert [r[0] for r in df.select(manifests.syntax_of(F.col("path"), F.col("text"))).collect()] == ["html", "html", "markdown"]
