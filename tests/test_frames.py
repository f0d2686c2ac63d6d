"""Contrast frames, scalar rules on names: values by hand, and the frames' SQL on the same texts."""

import pytest
from compare import connect, same
from pyspark.sql import functions as F

from quillspark.functions import names
from quillspark.operators import frames
from quillspark.plans import frames as plans

TEXTS = [
    (0, None),
    (1, ""),
    (2, "Is it a cache, or is it just a map? Is it just a map or a cache?"),
    (3, "A question: Are these merely hints, or rules? Can it be not just fast or slow? Is it just about done or late?"),
    (4, "Is it simply late or? Is it fast or only slow? Do we only read or also write? fine."),
    (5, "It is not just a map, it's a cache. It's not a map — it is a cache. It's not just fast but also small."),
    (6, "It's not a map. It's a cache. It is late."),
    (7, "It's not a. It's not b. It's not c. It's d."),
    (8, "It's not a. It's not just b, it's c. It's not d. It is e."),
    (9, "It's not a! It's b. It’s not c. It's d."),
    (10, "Not just x, and\nnot just y,\nit is z."),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string")


def test_frames_by_hand(docs):
    got = sorted((r.doc_id, r.sent_ix, r.n_sents, r.marker or "") for r in frames.contrast(docs).collect())
    assert got == [
        (2, 1, 1, "just"),
        (3, 0, 1, "merely"),
        (4, 2, 1, "only"),
        (5, 0, 1, ""),
        (5, 1, 1, ""),
        (6, 0, 2, ""),
        (7, 0, 2, ""),
        (7, 2, 2, ""),
        (8, 0, 2, ""),
        (8, 2, 2, ""),
        (10, 0, 1, ""),  # white space before the second limb may be a line break
    ]


def test_frames_by_sql(docs, small_dir):
    con = connect(small_dir)
    con.execute("DROP VIEW documents")
    con.register("documents", docs.toPandas())
    same(con, frames.contrast(docs), plans.ORACLES["contrast_frames"])


def test_frames_of_no_rows(docs):
    assert frames.contrast(docs.where("false")).count() == 0


def _one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_suffixes(spark):
    forms = lambda w: set(_one(spark, names.suffix_reductions(F.lit(w))))
    assert forms("tried") == {"try", "tri", "trie"}
    assert forms("stopped") == {"stop", "stopp", "stoppe"}
    assert forms("seeing") == {"see", "seee"}
    assert forms("flies") == {"fly", "fli", "flie"}
    assert forms("map") == set()


def test_names(spark):
    assert [_one(spark, names.coarse_tag(F.lit(t))) for t in ("VBZ", "N", ".", "``")] == ["VB", "N", ".", "``"]
    assert _one(spark, names.frame_prefix(F.lit("a.b.c"))) == "a" and _one(spark, names.frame_prefix(F.lit("a"))) == "a"
    assert _one(spark, names.stable_hash(F.lit("abc"))) == 0xBA7816BF8F01CFEA
    assert _one(spark, names.family_of(F.lit("Qwen2.5-7B"))) == "qwen"
    with pytest.raises(Exception, match="no family for model"):
        _one(spark, names.family_of(F.lit("other")))
    assert _one(spark, names.slice_of(F.lit("abcdef"), F.lit(1), F.lit(3))) == "bc"
    assert not _one(spark, names.overlaps(F.lit(0), F.lit(2), F.lit(2), F.lit(3)))


def test_literal_phrases():
    assert names.literal_phrase(r"(?i)\bIn short\b") == "in short"
    assert names.literal_phrase(r"it's worth\s+") == "it's worth"
    assert [names.literal_phrase(p) for p in (r"\ba|b\b", r"^a\b", r"\ba  b\b", "plain", r"\b\b", r"\bab+\b")] == [None] * 6
