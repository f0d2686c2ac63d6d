"""Differential runs against a plain walk over random curves; matching statistics against a search of every suffix."""

import random

from quillspark.operators import mining


def walk(m, h):
    d = [a - b for a, b in zip(m, h, strict=True)]
    out, at = [], 0
    while at < len(d):
        stop = at
        if d[at] >= 3:
            while stop < len(d) and d[stop] >= 2:
                stop += 1
            if stop - at >= 2:
                left = max(0, at - max(m[at] - 1, 0))
                best = max((sum(d[s : s + k]), -s, -k) for k in (2, 3, 4) for s in range(left, stop - k + 1))
                out.append((left, stop, sum(d[at:stop]), -best[1], -best[2]))
        at = max(stop, at + 1)
    return out


def test_runs_and_windows(spark):
    rng = random.Random(5)
    curves = {k: [(rng.randint(0, 8), rng.randint(0, 3)) for _ in range(rng.choice([0, 1, 2, 5, 60]))] for k in range(60)}
    rows = [(k, i, m, h, m - h) for k, c in curves.items() for i, (m, h) in enumerate(c)]
    curve = spark.createDataFrame(rows, "doc_id long, tok_ix long, m long, h long, d long")
    got = sorted(tuple(r) for r in mining.differential_spans(curve).collect())
    want = sorted((k, *r) for k, c in curves.items() for r in walk([m for m, _ in c], [h for _, h in c]))
    assert got == want and len(want) > 20


def test_matching_statistics_by_search(spark):
    rng = random.Random(6)
    make = lambda n: [(k, " ".join(rng.choice("ab c".split()) for _ in range(rng.randint(0, 12)))) for k in range(n)]
    docs, ref = [*make(20), (20, None), (21, "")], make(4)
    schema = "doc_id long, text string"
    got = {(r.doc_id, r.tok_ix): r.m for r in mining.matching_stats(spark.createDataFrame(docs, schema), spark.createDataFrame(ref, schema), 5).collect()}
    have = {tuple(t.split()[i : i + n]) for _, t in ref for n in range(1, 6) for i in range(len(t.split()) - n + 1)}
    want = {}
    for k, t in docs:
        w = (t or "").split()
        for i in range(len(w)):
            want[k, i] = max((n for n in range(1, min(5, i + 1) + 1) if tuple(w[i + 1 - n : i + 1]) in have), default=0)
    assert got == want


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert [tuple(r) for r in mining.differential(one, none, none, 4).orderBy("tok_ix").collect()] == [(1, 0, 0, 0, 0), (1, 1, 0, 0, 0)]
    assert mining.differential_spans(mining.differential(none, one, one, 4)).count() == 0
