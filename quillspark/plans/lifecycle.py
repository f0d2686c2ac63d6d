"""Queries over lifecycle operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import lifecycle, mining, relations, spans
from ..session import table
from . import reports
from .oracles import CLASSED, LIT, TX, VALUES, _grams, _k2, _ws
from .style import _regex

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def _docs(spark, d):
    return table(spark, d, "documents")


def _pass(t: str) -> str:
    named = " ".join(f"WHEN '&{k};' THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in lifecycle.ENTITIES.items())
    digits = "regexp_extract(r, '^&#[xX]?\\+?0*([0-9a-fA-F]*);$', 1)"
    code = f"CASE WHEN {digits} = '' THEN 0 WHEN length({digits}) > 8 THEN NULL WHEN regexp_matches(r, '^&#[xX]') THEN ('0x' || {digits})::BIGINT ELSE {digits}::BIGINT END"
    char = f"CASE WHEN ({code}) < 55296 OR ({code}) BETWEEN 57344 AND 1114111 THEN chr(({code})::INT) ELSE r END"
    one = f"list_transform(regexp_extract_all({t}, {_regex(lifecycle.REFERENCE)}), lambda r: CASE WHEN starts_with(r, '&#') THEN {char} ELSE CASE r {named} END END)"
    return f"array_to_string(list_transform(list_zip(regexp_split_to_array({t}, {_regex(lifecycle.REFERENCE)}), {one}), lambda z: z[1] || coalesce(z[2], '')), '')"


_NORMAL = "n0 AS (SELECT page_id, replace(replace(coalesce(html, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM pages), " + ", ".join(
    f"n{k} AS (SELECT page_id, {_pass('t')} AS t FROM n{k - 1})" for k in range(1, lifecycle.PASSES + 1)
)


@query(f"WITH {_NORMAL} SELECT page_id, length(t) AS n_chars, sha256(t) AS sha256 FROM n{lifecycle.PASSES}")
def corpus_normalise(spark, d):
    p = lifecycle.normalised(table(spark, d, "pages").select("page_id", "html"), "html")
    return p.select("page_id", F.length("html").cast("long").alias("n_chars"), F.sha2("html", 256).alias("sha256"))


@query(f"SELECT doc_id, n AS n_words, n >= 300 AS kept, n BETWEEN 300 AND 2000 AS in_range FROM (SELECT doc_id, len({_ws(TX)}) AS n FROM documents)")
def length_gate(spark, d):
    return lifecycle.length_gate(_docs(spark, d))


@query(f"SELECT token, count(*) AS n, row_number() OVER (ORDER BY token) - 1 AS id FROM (SELECT unnest({_k2(TX)}) AS token FROM documents) GROUP BY token")
def vocabulary_ids(spark, d):
    return lifecycle.vocabulary(_docs(spark, d))


@query(f"""WITH {LIT}, w AS (SELECT doc_id, len({_ws(TX)}) AS n FROM documents), k AS (SELECT doc_id, count(*) AS k FROM lit GROUP BY 1),
r AS (SELECT max(CASE WHEN n > 0 THEN coalesce(k, 0) * 1000.0::DOUBLE / n ELSE 0 END) AS top FROM w LEFT JOIN k USING (doc_id)) SELECT round(top, 6) AS max_rate, ceil(top * 1.15::DOUBLE * 100) / 100 AS ceiling FROM r""")
def near_noop_ceiling(spark, d):
    words = _docs(spark, d).select("doc_id", F.size(T.spaced_words(F.coalesce("text", F.lit("")))).alias("n_words"))
    return lifecycle.edit_ceiling(spans.literal_spans(_docs(spark, d), reports.PHRASES), words)


@query(f"""WITH {VALUES}, {CLASSED}, x AS (SELECT genre, class, metric, v FROM v JOIN c USING (doc_id)) SELECT genre, class, metric, count(v) AS n, round(avg(v), 6) AS mean, round(median(v), 6) AS median FROM x GROUP BY 1, 2, 3""")
def metric_summary(spark, d):
    c = relations.classed(_docs(spark, d), table(spark, d, "labels")).select("doc_id", "class")
    return lifecycle.summary(reports._values(spark, d).join(c, "doc_id"))


@query(f"""WITH {CLASSED}, {_grams(1)}, t AS (SELECT sum(a) AS ta, sum(b) AS tb FROM g)
SELECT ngram, round((a + b) * 1e6::DOUBLE / (ta + tb), 6) AS pooled_pm, round(greatest(a * 1e6::DOUBLE / ta, b * 1e6::DOUBLE / tb), 6) AS best_pm FROM g, t""")
def pooled_rates(spark, d):
    c = mining.with_totals(mining.ngram_counts(relations.classed(_docs(spark, d), table(spark, d, "labels")), 1))
    x = (F.col("a"), F.col("ta"), F.col("b"), F.col("tb"))
    return c.select("ngram", F.round(lifecycle.pooled_rate(*x), 6).alias("pooled_pm"), F.round(lifecycle.best_rate(*x), 6).alias("best_pm"))


@query("""WITH m AS (SELECT doc_id::VARCHAR AS id, coalesce(sha256(text), '') AS s, text, row_number() OVER (PARTITION BY lang ORDER BY sha256(doc_id::VARCHAR), doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents),
h AS (SELECT id, CASE WHEN id LIKE '%3' THEN '0' ELSE s END AS s, CASE WHEN id LIKE '%7' THEN NULL ELSE text END AS text, NOT (i < n * 85 // 100) AS held FROM m)
SELECT id, 'text digest' AS problem FROM h WHERE held AND id NOT LIKE '%5' AND text IS NOT NULL AND s = '0'
UNION ALL SELECT id, 'missing text' FROM h WHERE held AND id NOT LIKE '%5' AND text IS NULL
UNION ALL SELECT id, 'not in lock' FROM h WHERE held AND id LIKE '%5'""")
def holdout_check(spark, d):
    """A lock over the held-out documents with three kinds of faults put in by the id's last digit."""
    docs = _docs(spark, d)
    split = mining.split_assign(docs.select("doc_id", "lang"), ["lang"]).select("doc_id", "split")
    last = F.substring(F.col("id"), -1, 1)
    m = docs.join(split, "doc_id").select(F.col("doc_id").cast("string").alias("id"), "split", "text")
    m = m.withColumn("sha256", F.when(last == "3", "0").otherwise(F.coalesce(F.sha2("text", 256), F.lit(""))))
    lock = m.where("split = 'holdout'").where(last != "5").select("id", "sha256")
    return lifecycle.holdout_check(lock, m.select("id", "split", "sha256"), m.where(last != "7").select("id", "text"))
