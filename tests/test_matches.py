"""Matching statistics that travel packed: rows shuffled, rows without an id, packing."""

import numpy as np

from quillspark.operators import matches, mining


def shuffled(spark) -> dict[int, int]:
    """Rows written to a shuffle, by stage."""
    jvm, gw = spark._jvm, spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gw.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return {stages.apply(k).stageId(): stages.apply(k).shuffleWriteRecords() for k in range(stages.size())}


def test_no_row_for_each_ngram(spark):
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}" for k in range(676)]
    docs = spark.createDataFrame([(k, " ".join(words[k * 7 % 600 :] + words)) for k in range(30)], "doc_id long, text string")
    before = shuffled(spark)
    got = mining.differential(docs, docs.where("doc_id < 10"), docs.where("doc_id > 20"), 8)
    n = got.count()
    sent = sum(v for k, v in shuffled(spark).items() if k not in before)
    assert n > 20_000 and sent < n


def test_rows_without_an_id_and_equal_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d e"), (1, "b c"), (1, "c d x")], "doc_id long, text string")
    ref = spark.createDataFrame([(None, "a b c d"), (1, "d e")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.tok_ix, r.m) for r in mining.matching_stats(docs, ref, 4).collect())
    assert got == sorted([(0, 0, 1), (0, 1, 2), (0, 2, 3), (0, 3, 4), (0, 4, 2), (1, 0, 1), (1, 1, 2), (1, 0, 1), (1, 1, 2), (1, 2, 0)])


def test_packing():
    rng = np.random.default_rng(3)
    dense = np.unique(rng.integers(0, 1 << 62, 200_000).astype(np.uint64))
    for v in (dense, dense[:1], dense[::5000], np.array([0, 5, 2**64 - 1], np.uint64)):
        assert (matches.unpacked(matches.packed(v)) == v).all()
    assert len(matches.packed(dense)) < 6.1 * len(dense)
