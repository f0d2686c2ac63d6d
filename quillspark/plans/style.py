"""Queries over the vector of untagged metrics, and over words and names, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import style
from ..session import table
from .oracles import TX, _alow, _k3, _sent, _ws

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _regex(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


def _opens(s: str, markers: list[str]) -> str:
    return f"regexp_matches({_alow(s)}, {_regex(style.opener_pattern(markers))})"


_T = f"regexp_replace(regexp_replace({TX}, {_regex(style.FENCES[0])}, '', 'g'), {_regex(style.FENCES[1])}, '', 'g')"
_ONE = [k for k in style.CONTRACTIONS if " " not in k]
_TWO = [k for k in style.CONTRACTIONS if " " in k]


@query(rf"""WITH a AS (SELECT doc_id, {_T} AS t FROM documents),
b AS (SELECT doc_id, t, list_filter(list_transform(regexp_split_to_array(t, '\n[ \t\r]*\n'), lambda u: list_filter({_sent('u')}, lambda x: regexp_matches(x, '[^ \t\r\n]'))), lambda x: len(x) > 0) AS p FROM a),
c AS (SELECT *, flatten(p) AS s, list_transform(p, lambda x: len(x)) AS shape FROM b),
e AS (SELECT *, list_transform(s, lambda x: {_k3('x')}) AS w FROM c),
f AS (SELECT *, flatten(w) AS fw, flatten(list_transform(w, lambda x: list_transform(range(1, len(x)), lambda i: x[i] || ' ' || x[i + 1]))) AS pairs, string_split(t, chr(10)) AS lines, len({_ws('t')}) AS spaced FROM e),
g AS (SELECT *, len(fw) AS n, len(list_filter(fw, lambda x: x IN ({_quoted(style.CONTRACTIONS.values())}))) AS short, len(list_filter(fw, lambda x: x IN ({_quoted(_ONE)}))) + len(list_filter(pairs, lambda x: x IN ({_quoted(_TWO)}))) AS long,
  len(regexp_extract_all(t, '—')) + len(regexp_extract_all(regexp_replace(t, '([\p{{L}}\p{{N}}])', '\1\1', 'g'), '[\p{{L}}\p{{N}}] ?-- ?[\p{{L}}\p{{N}}]')) AS dashes,
  coalesce(list_avg(shape), 0.0) AS mean, coalesce(list_stddev_pop(shape), 0.0) AS sd FROM f)
SELECT doc_id, round(mean, 6) AS paragraph_shape_mean, round(CASE WHEN mean > 0 THEN sd / mean ELSE 0.0 END, 6) AS paragraph_shape_cv,
CASE WHEN spaced > 0 THEN round(dashes * 1000.0 / spaced, 6) ELSE 0.0 END AS em_dash_density,
CASE WHEN n > 0 THEN round(len(list_filter(s, lambda x: {_opens('x', style.DISCOURSE_MARKERS)})) * 1000.0 / n, 6) ELSE 0.0 END AS discourse_marker_density,
CASE WHEN short + long > 0 THEN round(short / (short + long), 6) ELSE 0.0 END AS contraction_ratio,
CASE WHEN len(p) > 0 THEN round(len(list_filter(p, lambda x: {_opens('x[1]', style.RITUAL_MARKERS)} OR {_opens('x[-1]', style.RITUAL_MARKERS)})) / len(p), 6) ELSE 0.0 END AS ritual_marker_rate,
CASE WHEN len(s) > 0 THEN round(len(list_filter(s, lambda x: regexp_matches(x, {_regex(style.NOT_JUST_BUT)}))) / len(s), 6) ELSE 0.0 END AS not_just_but_rate,
CASE WHEN n > 0 THEN round(len(list_filter(lines, lambda x: regexp_matches(x, {_regex(style.HEADING)}))) * 1000.0 / n, 6) ELSE 0.0 END AS heading_density,
CASE WHEN n > 0 THEN round(len(list_filter(lines, lambda x: regexp_matches(x, {_regex(style.ITEM)}))) * 1000.0 / n, 6) ELSE 0.0 END AS list_item_density FROM g""")
def style_vector(spark, d):
    return style.vector(table(spark, d, "documents"))
