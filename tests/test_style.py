"""The untagged metrics on small texts with values worked out by hand."""

import pytest
from compare import connect, same

from quillspark.operators import style
from quillspark.plans import style as plans

TEXTS = {
    0: None,
    1: "",
    2: "Speed matters — quality matters too. It works fine--somehow; trust me.",
    3: "a--b--c and d -- e but --- not f --  g",
    4: "**Overall:** it is fine. Don't go.\n\nWe are here. However, we're late. In today’s world, nothing lasts.\n\n   \n",
    5: "It is not just fast but also small. Not\nonly here. But there.",
    6: "# Title\n\n- one item\n- two\n1. three\n\n```\n# not a heading\n- not an item\n```\nEnd.",
    7: "It is.\nIs. Not here. cannot",
    8: "```\nnever closed. However, hidden.",
}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string")


@pytest.fixture(scope="module")
def rows(docs):
    return {r.doc_id: r for r in style.vector(docs).collect()}


def test_empty_texts_are_zero(rows):
    for k in (0, 1, 8):
        assert all(v == 0 for c, v in rows[k].asDict().items() if c != "doc_id")


def test_dashes(rows):
    assert rows[2].em_dash_density == pytest.approx(2 * 1000 / 11, abs=1e-6)
    assert rows[3].em_dash_density == pytest.approx(3 * 1000 / 11, abs=1e-6)  # a--b, b--c, d -- e


def test_paragraphs_and_rituals(rows):
    r = rows[4]
    assert r.paragraph_shape_mean == 2.5
    assert r.paragraph_shape_cv == 0.2
    assert r.ritual_marker_rate == 1.0
    assert r.contraction_ratio == 0.5  # don't, we're against it is, we are
    assert r.discourse_marker_density == pytest.approx(2 * 1000 / 17, abs=1e-6)


def test_contractions_stay_in_a_sentence(rows):
    assert rows[7].contraction_ratio == 0.0
    assert rows[5].not_just_but_rate == pytest.approx(1 / 3, abs=1e-6)


def test_blocks_outside_fences(rows):
    r = rows[6]
    assert r.heading_density == pytest.approx(1000 / 6, abs=1e-6)
    assert r.list_item_density == pytest.approx(3 * 1000 / 6, abs=1e-6)


def test_repeated_rows_and_empty_table(spark, docs):
    assert style.vector(docs.unionByName(docs)).count() == 2 * len(TEXTS)
    assert style.vector(docs.where("false")).count() == 0


def test_sql_gives_the_same_on_these_texts(docs, small_dir):
    con = connect(small_dir)
    con.execute("DROP VIEW documents")
    con.register("documents", docs.toPandas())
    same(con, style.vector(docs), plans.ORACLES["style_vector"])
