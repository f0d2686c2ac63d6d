"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing extra columns, for every operator."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quillspark.llm import bpe, compression, crf, cws, disclosure, minhash, pfair, ranking, simple8b, styletree

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, t string, row string, h string, slot string, key string, score string"
RANKS, JSON = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")


def _row(i, t, source="a"):
    return (i, t, None, source, None, "x", "y", None, "h", "s", "k", "z")


LONG = " ".join(f"word{k % 977} and é{k % 13}" for k in range(40_000))
ROWS = [
    _row(1, "one two three four five six seven"),
    _row(1, "one two three four five six seven"),
    _row(2, "one two three four five six seven", "b"),
    _row(3, None),
    _row(4, ""),
    _row(5, " \t\n ", None),
    _row(None, "nothing to see here at all, a@b.co", None),
    _row(None, None),
    _row(6, LONG, "b"),
    _row(7, "call +49 170 1234567 or write to x.y@example.com from 10.0.0.1\x00 end"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3, F.rand(3))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def _mix(d):
    return pfair.places(d, pfair.slots_of(pfair.tempered(pfair.sizes(d)) or {"a": 1.0}, 20), block=2)


def _sorted(d):
    return pfair.order(d, pfair.slots_of(pfair.tempered(pfair.sizes(d)) or {"a": 1.0}, 20), block=2)


def _files(d):
    return simple8b.read_ids(d.sparkSession, simple8b.write_ids(d, JSON, public_tokenizers.PATTERN, 2))


def _labels(d):
    return d.sparkSession.createDataFrame([(1, 1), (1, 0), (6, 0), (None, 1), (9, None)], "doc_id long, y int")


OPERATORS = {
    "compression": compression.rules,
    "disclosure": lambda d: disclosure.digest(disclosure.find(d)),
    "sanitise": disclosure.sanitise,
    "places": _mix,
    "order": _sorted,
    "files": _files,
    "ranking": lambda d: ranking.score(d, ranking.train(d, _labels(d), "y")),
    "keep": lambda d: ranking.keep(d, ranking.train(d, _labels(d).where("y is null"), "y")),
    "minhash": minhash.classes,
    "crf": lambda d: crf.score(d, crf.train(d, _labels(d), "y")),
    "bpe": lambda d: bpe.digest(bpe.decode(bpe.encode(d, RANKS, public_tokenizers.PATTERN), RANKS)),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_a_row_for_each_row(docs, name):
    got = OPERATORS[name](docs).select("doc_id").collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((r[0] is None, r[0] or 0) for r in ROWS)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(none, name):
    assert OPERATORS[name](none).count() == 0


def test_weighted_sampling_has_a_row_for_each_document(docs, none):
    got = cws.compare(docs).collect()
    assert len(got) == len({r[:2] for r in [(x[0], x[1] or "") for x in ROWS]})
    assert cws.compare(none).count() == 0


def test_style_tree_edges(spark):
    rows = [(1, "http://h.example/a", None, "x"), (None, None, "<p>a &amp; b</p>", "x"), (2, "no host", "", "x"), (2, "no host", "", "x"), (3, "http://h.example/b", "<div><p>x" + "<b>y</b> " * 5000, "x")]
    schema = "page_id long, url string, html string, node string"
    got = styletree.extract(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 5
    text = {r.page_id: r.text for r in got}
    assert text[1] == text[2] == "" and text[None] == "a & b"
    assert text[3] == ("xy " + "y " * 4999).strip()
    assert styletree.extract(spark.createDataFrame([], schema)).count() == 0
