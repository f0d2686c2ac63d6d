"""Queries over contrast frames and small scalar rules, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names
from ..operators import frames, relations
from ..session import table
from .oracles import STRAIGHT, TX, _alow, _k2, _sent
from .style import _quoted, _regex

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


_K1 = "regexp_extract_all(" + _alow(STRAIGHT.replace("{x}", "s")) + ", '[a-z'']+|[.,;:!?]')"
_TEXTS = f"tx AS (SELECT doc_id, {_sent(TX)} AS s FROM documents), sn AS (SELECT doc_id, unnest(range(0, len(s))) AS sent_ix, unnest(s) AS s FROM tx)"
_QUESTIONS = f"""qa AS (SELECT doc_id, sent_ix, {_K1} AS t FROM sn),
qb AS (SELECT *, list_min(list_filter(range(1, len(t) + 1), lambda i: t[i] IN ({_quoted(frames.AUXILIARIES)}))) AS aux FROM qa WHERE t[-1] = '?'),
qc AS (SELECT *, list_min(list_filter(range(1, len(t) + 1), lambda i: i > aux AND t[i] = 'or')) AS o FROM qb),
qd AS (SELECT *, list_min(list_filter(range(1, len(t) + 1), lambda i: i > aux AND i < o AND t[i] IN ({_quoted(frames.MARKERS)}) AND NOT (i > 1 AND t[i - 1] = 'not') AND t[i + 1] NOT IN ({_quoted(frames.GUARDS)}))) AS m FROM qc WHERE o + 1 < len(t))"""
_CORRECTIONS = f"""ca AS (SELECT doc_id, sent_ix, s, lead(s) OVER (PARTITION BY doc_id ORDER BY sent_ix) AS nxt FROM sn),
cb AS (SELECT doc_id, sent_ix, CASE WHEN regexp_matches(s, {_regex(frames.MARKED)}) OR regexp_matches(s, {_regex(frames.SINGLE)}) THEN 1
  WHEN regexp_matches(s, {_regex(frames.FIRST)}) AND regexp_matches(s, '\\.\\s*$') AND coalesce(regexp_matches(nxt, {_regex(frames.SECOND)}), false) THEN 2 ELSE 0 END AS k FROM ca),
walk AS (SELECT doc_id, 0::BIGINT AS sent_ix, k, k > 0 AS hit, k = 2 AS ate FROM cb WHERE sent_ix = 0
  UNION ALL SELECT n.doc_id, n.sent_ix, n.k, n.k > 0 AND NOT w.ate, n.k = 2 AND NOT w.ate FROM walk w JOIN cb n ON n.doc_id = w.doc_id AND n.sent_ix = w.sent_ix + 1)"""


@query(f"""WITH RECURSIVE {_TEXTS}, {_QUESTIONS}, {_CORRECTIONS}
SELECT doc_id, sent_ix, 1::BIGINT AS n_sents, '{frames.QUESTION}' AS frame_id, t[m] AS marker FROM qd WHERE m IS NOT NULL
UNION ALL SELECT doc_id, sent_ix, k::BIGINT, '{frames.CORRECTION}', NULL FROM walk WHERE hit""")
def contrast_frames(spark, d):
    return frames.contrast(table(spark, d, "documents"))


@query(f"""WITH w AS (SELECT DISTINCT unnest({_k2(TX)}) AS token FROM documents),
c AS (SELECT token, [CASE WHEN token LIKE '%ied' THEN token[:-4] || 'y' END,
 CASE WHEN length(token) > 3 AND token LIKE '%ed' AND token[-3:-3] = token[-4:-4] AND token[-3:-3] NOT IN ('a', 'e', 'i', 'o', 'u') THEN token[:-4] END, CASE WHEN token LIKE '%ed' THEN token[:-3] END, CASE WHEN token LIKE '%ed' THEN token[:-3] || 'e' END,
 CASE WHEN length(token) > 4 AND token LIKE '%ing' AND token[-4:-4] = token[-5:-5] AND token[-4:-4] NOT IN ('a', 'e', 'i', 'o', 'u') THEN token[:-5] END, CASE WHEN token LIKE '%ing' THEN token[:-4] END, CASE WHEN token LIKE '%ing' THEN token[:-4] || 'e' END,
 CASE WHEN token LIKE '%ies' THEN token[:-4] || 'y' END, CASE WHEN token LIKE '%es' THEN token[:-3] END, CASE WHEN token LIKE '%s' THEN token[:-2] END] AS r FROM w)
SELECT token, ('0x' || sha256(token)[:16])::UBIGINT::VARCHAR AS hash64, array_to_string(list_sort(list_distinct(list_filter(r, lambda x: x IS NOT NULL))), ' ') AS stems FROM c""")
def token_rules(spark, d):
    """Digest and candidate base forms of each distinct token."""
    t = relations.tokens(table(spark, d, "documents")).select("token").distinct()
    return t.select("token", names.stable_hash(F.col("token")).cast("string").alias("hash64"), F.array_join(F.array_sort(names.suffix_reductions(F.col("token"))), " ").alias("stems"))
