"""Lifecycle operators on small tables with results worked out by hand."""

import pytest
from compare import connect, same
from pyspark.sql import functions as F

from quillspark.operators import lifecycle
from quillspark.plans import lifecycle as plans

TEXTS = "doc_id long, text string"
PAGES = [
    (0, None, ""),
    (1, "a\r\nb\rc", "a\nb\nc"),
    (2, "&amp;amp;lt; &lt;p&gt;", "< <p>"),
    (3, "&amp;amp;amp;amp;amp;lt;", "&amp;lt;"),  # four times, no more
    (4, "&#65;&#x1F600;&#X41;&#+66;&#0000000000065;", "A😀AB" + "A"),
    (5, "&#xD800; &#1114112; &#99999999999999; &#; &bogus; & amp;", "&#xD800; &#1114112; &#99999999999999; &#; &bogus; & amp;"),
    (6, "x&nbsp;y&hellip;&&quot;", "x y…&\""),
]


def test_normalised(spark):
    docs = spark.createDataFrame([(k, t) for k, t, _ in PAGES], TEXTS)
    got = {r.doc_id: r.text for r in lifecycle.normalised(docs).collect()}
    assert got == {k: want for k, _, want in PAGES}
    assert lifecycle.normalised(docs.where("false")).count() == 0


def test_normalised_by_sql(spark, small_dir):
    pages = spark.createDataFrame([(k, t) for k, t, _ in PAGES], "page_id long, html string")
    con = connect(small_dir)
    con.execute("DROP VIEW pages")
    con.register("pages", pages.toPandas())
    got = lifecycle.normalised(pages, "html").select("page_id", F.length("html").cast("long").alias("n_chars"), F.sha2("html", 256).alias("sha256"))
    same(con, got, plans.ORACLES["corpus_normalise"])


def test_length_gate(spark):
    docs = spark.createDataFrame([(1, None), (2, "a b"), (3, " a\tb\nc "), (4, "a b c d")], TEXTS)
    got = [tuple(r) for r in lifecycle.length_gate(docs, 2, 3).orderBy("doc_id").collect()]
    assert got == [(1, 0, False, False), (2, 2, True, True), (3, 3, True, True), (4, 4, True, False)]


def _manifest(spark, rows):
    return spark.createDataFrame(rows, "id string, class string, genre string, license string, split string, sha256 string")


def test_seal_and_check(spark):
    texts = spark.createDataFrame([("a", "one"), ("b", "two"), ("c", "three")], "id string, text string")
    sha = {r.id: r.s for r in texts.select("id", F.sha2("text", 256).alias("s")).collect()}
    m = _manifest(spark, [("a", "human", "docs", "MIT", "holdout", sha["a"]), ("b", "human", "forum", " cc-by-sa-4.0", "holdout", sha["b"]), ("c", "llm", "docs", None, "train", sha["c"])])
    lock = lifecycle.seal(m, texts)
    assert sorted(tuple(r) for r in lock.collect()) == [("a", sha["a"], "human/docs/a.md"), ("b", sha["b"], "quarantine/forum/b.md")]
    assert lifecycle.holdout_check(lock, m, texts).count() == 0
    with pytest.raises(Exception, match="stale manifest"):
        lifecycle.seal(m, texts.withColumn("text", F.lit("other"))).collect()
    bad = _manifest(spark, [("a", "human", "docs", "MIT", "train", "x"), ("c", "llm", "docs", None, "holdout", sha["c"])])
    got = sorted(tuple(r) for r in lifecycle.holdout_check(lock, bad, texts.where("id <> 'b'")).collect())
    assert got == [("a", "manifest digest"), ("a", "split"), ("b", "missing text"), ("b", "not in manifest"), ("c", "not in lock")]


def test_vocabulary_is_in_order(spark):
    docs = spark.createDataFrame([(1, "b a, abc abd"), (2, "a ab"), (3, None)], TEXTS)
    got = [tuple(r) for r in lifecycle.vocabulary(docs).orderBy("id").collect()]
    assert got == [(",", 1, 0), ("a", 2, 1), ("ab", 1, 2), ("abc", 1, 3), ("abd", 1, 4), ("b", 1, 5)]


def test_edit_ceiling(spark):
    words = spark.createDataFrame([(1, 100), (2, 0), (3, 300)], "doc_id long, n_words int")
    edits = spark.createDataFrame([(1,), (3,), (3,), (2,)], "doc_id long")
    assert tuple(lifecycle.edit_ceiling(edits, words).first()) == (10.0, 11.5)
    assert tuple(lifecycle.edit_ceiling(edits.where("false"), words).first()) == (0.0, 0.0)
    assert tuple(lifecycle.edit_ceiling(edits, words.where("false")).first()) == (0.0, 0.0)


def test_touched_sentences(spark):
    rows = [("x", "One. Two. Three.", "One. 2. Three."), ("x", "Same.", "Same."), ("y", None, None)]
    got = {r.genre: tuple(r)[1:] for r in lifecycle.touched(spark.createDataFrame(rows, "genre string, before string, after string"), ["genre"]).collect()}
    assert got == {"x": (2, 4, 0.25), "y": (1, 0, 0.0), None: (3, 4, 0.25)}


def test_excess_words(spark):
    rows = [(1, "It is a fast tool.", "A fast tool."), (2, "the map", "the the map grows"), (3, None, "new"), (4, None, None), (1, "a", "b")]
    pairs = spark.createDataFrame(rows, "doc_id long, input string, output string")
    got = sorted((r.doc_id, tuple(r.excess)) for r in lifecycle.excess_words(pairs).collect())
    assert got == [(1, ()), (1, ("b",)), (2, ("grows", "the")), (3, ("new",)), (4, ())]
    licensed = lifecycle.excess_words(pairs.where("doc_id = 2"), F.array(F.lit("grows"))).first()
    assert licensed.excess == ["the"]


def test_rates(spark):
    x = [F.lit(v) for v in (1, 10, 3, 100)]
    r = spark.range(1).select(lifecycle.pooled_rate(*x).alias("p"), lifecycle.best_rate(*x).alias("b"), lifecycle.pooled_rate(*[F.lit(0)] * 4).alias("z")).first()
    assert (round(r.p, 3), r.b, r.z) == (36363.636, 100000.0, 0.0)
