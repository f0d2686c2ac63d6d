"""What plans do once: tokens of a sentence, counts of n-grams."""

from quillspark.operators import mining


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_seams_make_tokens_once(spark):
    docs = spark.createDataFrame([(1, "A b. C!"), (2, None), (3, "?? 12. \n"), (4, "12")], "doc_id long, text string")
    out = mining.seams(docs)
    assert plan(out).count("regexp_extract_all(") == 1
    got = {(r["left"], r["right"]): r["n"] for r in out.collect()}
    pairs = [("<s>", "a"), ("a", "b"), ("b", "."), ("<s>", "c"), ("c", "!"), ("<s>", "?"), ("?", "?"), ("<s>", ".")]
    assert got == dict.fromkeys(pairs, 1)


def test_ratio_top_counts_bigrams_twice_at_most(spark):
    docs = spark.createDataFrame([("a", "x y z x y"), ("b", "x y x y q x y"), ("b", "x z x z")], "class string, text string")
    out = mining.ratio_top(docs, 2, mining.ngram_counts(docs, 1), 3, 9)
    # bigrams for the counts and for their totals, unigrams once for each word
    assert plan(out).count("Generate explode(") == 4
    assert sorted((r.ngram, r.a, r.b) for r in out.collect()) == [("x y", 2, 3), ("x z", 0, 2)]
