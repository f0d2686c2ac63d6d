"""DuckDB SQL for the queries of reports.py. Written from the operators' definitions, sharing named pieces of text."""

from __future__ import annotations

UP, LO = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _alow(x: str) -> str:
    return f"translate({x}, '{UP}', '{LO}')"


TX = "coalesce(text, '')"
STRAIGHT = "translate({x}, '‘’', '''''')"
CLEAN = (
    "regexp_replace(regexp_replace(regexp_replace(regexp_replace(" + STRAIGHT + r", '(?s)```.*?```', ' ', 'g'), '`[^`]*`', ' ', 'g'), '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '[#>*_|]', '', 'g')"
)


def _k2(x: str) -> str:
    return "regexp_extract_all(lower(" + CLEAN.replace("{x}", x) + "), '[a-z'']+|[.,;:!?]')"


def _k3(x: str) -> str:
    return f"regexp_extract_all({_alow(x)}, '\\p{{L}}+(?:[''’]\\p{{L}}+)*')"


def _ws(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> '')"


def _sent(x: str) -> str:
    return f"list_filter(string_split(regexp_replace({x}, '([.!?])[ \\t\\n\\r]+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s) <> '')"


PUNCT = "('.', ',', ';', ':', '!', '?')"
CLASSED = "c AS (SELECT d.*, CASE WHEN quality = 1 THEN 'a' ELSE 'b' END AS class FROM documents d JOIN labels USING (doc_id) WHERE quality IS NOT NULL)"
SEGMENTS = "list_filter(list_transform(regexp_split_to_array(" + _alow(STRAIGHT.replace("{x}", TX)) + r", '[^\p{L}''\s]+'), lambda p: list_filter(regexp_split_to_array(p, '\s+'), lambda w: w <> '')), lambda a: len(a) > 0)"


def _grams(n: int, source: str = "c", name: str = "g") -> str:
    """ngram, a, b of mining segments."""
    return f"""{name}s AS (SELECT class, unnest({SEGMENTS}) AS s FROM {source}),
{name}e AS (SELECT class, unnest(list_transform(range(1, len(s) - {n} + 2), lambda i: array_to_string(s[i:i + {n - 1}], ' '))) AS ngram FROM {name}s WHERE len(s) >= {n}),
{name} AS (SELECT ngram, count(*) FILTER (class = 'a') AS a, count(*) FILTER (class = 'b') AS b FROM {name}e GROUP BY 1)"""


TOT = "t AS (SELECT sum(a) AS ta, sum(b) AS tb FROM g)"
LOGODDS = """z AS (SELECT ngram, a, b, ln((2 * a + b) / (ta + (ta + tb) - a - (a + b))) - ln((a + 2 * b) / (tb + (ta + tb) - b - (a + b))) AS delta, sqrt(1.0 / (2 * a + b) + 1.0 / (a + 2 * b)) AS se FROM g, t)"""
RHYTHM = f"""n AS (SELECT doc_id, list_transform({_sent(TX)}, lambda s: len({_ws('s')})) AS n FROM documents),
m AS (SELECT doc_id, len(n) AS k, coalesce(list_avg(n), 0.0) AS mean, coalesce(list_stddev_pop(n), 0.0) AS sd FROM n),
rhythm AS (SELECT doc_id, k AS n_sentences, round(mean, 6) AS mean_words, round(sd, 6) AS sd_words, round(CASE WHEN mean > 0 THEN sd / mean ELSE 0 END, 6) AS cv_words FROM m)"""
OPEN = f"o AS (SELECT doc_id, list_filter(list_transform({_sent(TX)}, lambda s: ({_k3('s')})[1]), lambda w: w IS NOT NULL) AS o FROM documents)"
REPEAT = "r AS (SELECT doc_id, CASE WHEN len(o) > 1 THEN round(len(list_filter(range(2, len(o) + 1), lambda i: o[i] = o[i - 1])) / (len(o) - 1), 6) ELSE 0.0 END AS opener_repeat FROM o)"
VALUES = f"""{RHYTHM}, {OPEN}, {REPEAT},
v AS (SELECT doc_id, lang AS genre, unnest(['mean_words', 'cv_words', 'opener_repeat']) AS metric, unnest([mean_words, cv_words, opener_repeat]) AS v FROM rhythm JOIN r USING (doc_id) JOIN documents USING (doc_id))"""
BANDS = "bands AS (SELECT genre, metric, quantile_disc(v, 0.1) AS lo, quantile_disc(v, 0.5) AS mid, quantile_disc(v, 0.9) AS hi FROM v GROUP BY 1, 2)"


def _auc(source: str) -> str:
    return f"""k AS (SELECT metric, class, rank() OVER (PARTITION BY metric ORDER BY v) + (count(*) OVER (PARTITION BY metric, v) - 1) / 2.0 AS mid FROM {source}),
auc AS (SELECT metric, count(*) FILTER (class = 'a') AS na, count(*) FILTER (class = 'b') AS nb, sum(mid) FILTER (class = 'b') AS s FROM k GROUP BY 1),
auc2 AS (SELECT metric, CASE WHEN na > 0 AND nb > 0 THEN round((s - nb * (nb + 1) / 2.0) / (na * nb), 6) END AS auc, na, nb FROM auc)"""


def _burst(source: str, name: str = "burst") -> str:
    return f"""{name}t AS (SELECT doc_id, {_k2(TX)} AS t FROM {source}), {name}w AS (SELECT doc_id, len(t) AS n, unnest(t) AS word FROM {name}t),
{name}k AS (SELECT doc_id, n, word, count(*) AS k FROM {name}w WHERE word NOT IN {PUNCT} GROUP BY ALL),
{name} AS (SELECT word, sum(k)::BIGINT AS n, coalesce(max(round(k * 1e6 / n)) FILTER (n >= 120), 0.0) AS burst FROM {name}k GROUP BY 1 HAVING sum(k) >= 5)"""


def _seams(source: str, name: str) -> str:
    return f"""{name}s AS (SELECT unnest({_sent(TX)}) AS s FROM {source}), {name}t AS (SELECT list_concat(['<s>'], {_k2('s')}) AS t FROM {name}s),
{name}p AS (SELECT unnest(list_transform(range(1, len(t)), lambda i: {{'l': t[i], 'r': t[i + 1]}})) AS p FROM {name}t WHERE len(t) > 1),
{name} AS (SELECT p.l AS "left", p.r AS "right", count(*) AS n FROM {name}p GROUP BY 1, 2)"""


A, B = "ca AS (SELECT * FROM c WHERE class = 'a')", "cb AS (SELECT * FROM c WHERE class = 'b')"
def _ending(o: int) -> str:
    return " || ' ' || ".join([f"lag(tok, {k}) OVER w" for k in range(o - 1, 0, -1)] + ["tok"])


DMS = f"""{CLASSED}, tk AS (SELECT doc_id, class, unnest(range(0, len(t))) AS ix, unnest(t) AS tok FROM (SELECT doc_id, class, {_k2(TX)} AS t FROM c)),
gr AS (SELECT doc_id, class, ix, {", ".join(f"{_ending(o)} AS g{o}" for o in range(1, 5))} FROM tk WINDOW w AS (PARTITION BY doc_id ORDER BY ix)),
{", ".join(f"a{o} AS (SELECT DISTINCT g{o} FROM gr WHERE class = 'a' AND g{o} IS NOT NULL)" for o in range(1, 5))},
dms AS (SELECT doc_id, ix AS tok_ix, CASE WHEN a4.g4 IS NOT NULL THEN 4 WHEN a3.g3 IS NOT NULL THEN 3 WHEN a2.g2 IS NOT NULL THEN 2 WHEN a1.g1 IS NOT NULL THEN 1 ELSE 0 END::BIGINT AS m
  FROM gr LEFT JOIN a1 ON a1.g1 = gr.g1 LEFT JOIN a2 ON a2.g2 = gr.g2 LEFT JOIN a3 ON a3.g3 = gr.g3 LEFT JOIN a4 ON a4.g4 = gr.g4 WHERE class = 'b')"""


def _literal(phrases: list[str], name: str, channel: str) -> str:
    alt = "|".join(sorted(phrases, key=lambda p: (-len(p), p)))
    t = _alow(TX)
    return f"""{name}t AS (SELECT doc_id, {t} AS t, regexp_extract_all({t}, '{alt}') AS m, regexp_split_to_array({t}, '{alt}') AS g FROM documents),
{name}u AS (SELECT doc_id, t, m, unnest(range(1, len(m) + 1)) AS i, g FROM {name}t),
{name}l AS (SELECT doc_id, t, m[i] AS p, sum(length(g[i]) + length(m[i])) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM {name}u),
{name} AS (SELECT doc_id, (e - length(p))::INT AS "start", e::INT AS "end", '{channel}' AS channel, p AS frame_id FROM {name}l
  WHERE (e = length(p) OR NOT regexp_matches(substr(t, (e - length(p))::INT, 1), '^[\\p{{L}}'']$')) AND NOT regexp_matches(substr(t, (e + 1)::INT, 1), '^[\\p{{L}}'']$'))"""


PHRASES = ["of the", "the", "is the", "it is", "de la", "and the other"]
LIT = _literal(PHRASES, "lit", "literal")
TWO = f"{LIT}, {_literal(['the', 'of', 'it'], 'wrd', 'word')}, two AS (SELECT * FROM lit UNION ALL SELECT * FROM wrd UNION ALL SELECT * FROM lit)"
RESOLVED = TWO + """, ord AS (SELECT DISTINCT doc_id, "start", "end", channel AS rule, '<' || frame_id || '>' AS replacement FROM two),
num AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY "start", "end" DESC, rule, replacement) AS k FROM ord),
walk AS (SELECT doc_id, 1 AS k, "start", "end", rule, replacement, "end" AS upto, true AS took FROM num WHERE k = 1
  UNION ALL SELECT n.doc_id, n.k, n."start", n."end", n.rule, n.replacement, CASE WHEN n."start" >= w.upto THEN n."end" ELSE w.upto END, n."start" >= w.upto FROM walk w JOIN num n ON n.doc_id = w.doc_id AND n.k = w.k + 1),
res AS (SELECT doc_id, "start", "end", rule, replacement FROM walk WHERE took)"""
VERDICT = f"{CLASSED}, {_grams(2)}, g2 AS (SELECT * FROM g WHERE a + b >= 4), t AS (SELECT sum(a) AS ta, sum(b) AS tb FROM g2), q AS (SELECT ngram, b, round(((b + 0.5) / tb) / ((a + 0.5) / ta), 6) AS r FROM g2, t), vd AS (SELECT ngram, CASE WHEN r >= 2.0 AND b >= 2 THEN 'confirmed' WHEN r <= 0.67 THEN 'direction-error' WHEN r > 1.0 THEN 'weak' ELSE 'none' END AS verdict FROM q)"

ORACLES: dict[str, str] = {
    "doc_token_stats": f"SELECT doc_id, len(t) AS n_tokens, len(w) AS n_words, len(list_distinct(w)) AS n_distinct FROM (SELECT doc_id, t, list_filter(t, lambda x: x NOT IN {PUNCT}) AS w FROM (SELECT doc_id, {_k2(TX)} AS t FROM documents))",
    "sentence_rhythm": f"WITH {RHYTHM} SELECT * FROM rhythm",
    "opener_repeat": f"WITH {OPEN}, {REPEAT} SELECT * FROM r",
    "top_opener": f"WITH {OPEN}, e AS (SELECT doc_id, unnest(o) AS w FROM o), k AS (SELECT doc_id, w, count(*) AS k FROM e GROUP BY 1, 2), s AS (SELECT doc_id, max(k) AS m, sum(k) AS n FROM k GROUP BY 1) SELECT o.doc_id, CASE WHEN n > 0 THEN round(m / n, 6) ELSE 0.0 END AS top_opener FROM o LEFT JOIN s USING (doc_id)",
    "punct_density": f"""WITH x AS (SELECT doc_id, {TX} AS t, len({_ws(TX)}) AS n, len({_sent(TX)}) AS s FROM documents)
SELECT doc_id, CASE WHEN n > 0 THEN round((length(t) - length(replace(t, ';', ''))) * 1000.0 / n, 6) ELSE 0.0 END AS semicolon, CASE WHEN n > 0 THEN round((length(t) - length(replace(t, ',', ''))) * 1000.0 / n, 6) ELSE 0.0 END AS comma,
CASE WHEN s > 0 THEN round(((len(regexp_extract_all(t, '\\*\\*')) + len(regexp_extract_all(t, '__'))) // 2) / s, 6) ELSE 0.0 END AS bold FROM x""",
    "marker_density": f"WITH x AS (SELECT doc_id, len({_k3(TX)}) AS n, len(list_filter({_sent(TX)}, lambda s: regexp_matches({_alow('s')}, '^[\\s*_#>]*(?:the|is|it|la|der)(?:[^\\p{{L}}]|$)'))) AS k FROM documents) SELECT doc_id, CASE WHEN n > 0 THEN round(k * 1000.0 / n, 6) ELSE 0.0 END AS marker_density FROM x",
    "phrase_rate": f"""WITH x AS (SELECT doc_id, {_k3(TX)} AS w FROM documents), y AS (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda q: q = 'the')) + len(list_filter(range(1, len(w)), lambda i: (w[i] || ' ' || w[i + 1]) IN ('of the', 'is the', 'de la'))) AS k FROM x)
SELECT doc_id, CASE WHEN n > 0 THEN round(k * 1000.0 / n, 6) ELSE 0.0 END AS phrase_rate FROM y""",
    "tokenizer_sizes": f"SELECT doc_id, len(regexp_extract_all({_alow(STRAIGHT.replace('{x}', TX))}, '[a-z'']+|[.,;:!?]')) AS k1, len({_k2(TX)}) AS k2, len({_k3(TX)}) AS k3, len({_ws(TX)}) AS k6, strlen({TX}) AS bytes FROM documents",
    "text_digest": f"""SELECT doc_id, sha256({TX}) AS sha256, sha256(trim(regexp_replace(lower(translate({TX}, '_-', '  ')), '\\s+', ' ', 'g'))) AS compound_sha256, sha256(upper(substr(lower({TX}), 1, 1)) || substr(lower({TX}), 2)) AS capitalised_sha256, regexp_matches({TX}, '[.!?]["''’”)\\]]*\\s*$') AS ends_terminal FROM documents""",
    "ngram_counts": f"WITH {CLASSED}, {_grams(2)} SELECT * FROM g WHERE a + b >= 5",
    "log_odds_top": f"WITH {CLASSED}, {_grams(1)}, {TOT}, {LOGODDS}, y AS (SELECT ngram, a, b, round(delta, 6) AS delta, round(delta / se, 6) AS z FROM z) SELECT *, 'a' AS side FROM (FROM y ORDER BY z DESC, ngram LIMIT 40) UNION ALL SELECT *, 'b' AS side FROM (FROM y ORDER BY z, ngram LIMIT 40)",
    "ratio_top": f"""WITH {CLASSED}, {_grams(2)}, {_grams(1, name='u')}, {TOT}, f AS (SELECT ngram AS w, a + b AS f FROM u),
x AS (SELECT ngram, a, b, round(((b + 0.5) / tb) / ((a + 0.5) / ta), 6) AS ratio FROM g, t WHERE b >= 2)
SELECT x.* FROM x JOIN f f1 ON f1.w = split_part(ngram, ' ', 1) JOIN f f2 ON f2.w = split_part(ngram, ' ', 2) WHERE f1.f >= 5 AND f2.f >= 5 ORDER BY ratio DESC, ngram LIMIT 50""",
    "class_vocab_overlap": f"WITH {CLASSED}, {_grams(1)} SELECT count(*) FILTER (a > 0 AND b > 0) AS shared, count(*) FILTER (b = 0) AS only_a, count(*) FILTER (a = 0) AS only_b FROM g",
    "split_assign": "WITH x AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256(doc_id::VARCHAR), doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents) SELECT doc_id, lang, CASE WHEN i < n * 70 // 100 THEN 'train' WHEN i < n * 85 // 100 THEN 'dev' ELSE 'holdout' END AS split FROM x",
    "corpus_stats": f"WITH {CLASSED}, x AS (SELECT class, lang, len({_ws('text')}) AS n FROM c) SELECT class, lang, count(*) AS docs, min(n) AS min_words, round(avg(n), 6) AS mean_words, max(n) AS max_words FROM x GROUP BY ROLLUP (class, lang)",
    "metric_bands": f"WITH {VALUES}, {BANDS} SELECT * FROM bands",
    "metric_auc": f"WITH {VALUES}, {CLASSED}, vc AS (SELECT metric, class, v FROM v JOIN c USING (doc_id)), {_auc('vc')} SELECT * FROM auc2",
    "combined_score": f"WITH {VALUES}, {BANDS}, x AS (SELECT doc_id, least(1.0, (CASE WHEN v < lo THEN lo - v WHEN v > hi THEN v - hi ELSE 0 END) / (CASE WHEN hi > lo THEN hi - lo ELSE 1.0 END)) AS e FROM v JOIN bands USING (genre, metric)) SELECT doc_id, round(avg(e), 6) AS score FROM x GROUP BY 1",
    "envelope_union": f"WITH {VALUES}, {BANDS} SELECT metric, min(lo) AS lo, max(hi) AS hi, count(*) FILTER (hi > 2 * lo) * 2 > count(*) AS include FROM bands GROUP BY 1",
    "separation_gate": f"WITH {VALUES}, {CLASSED}, vc AS (SELECT genre || '/' || metric AS metric, class, v FROM v JOIN c USING (doc_id)), {_auc('vc')} SELECT count(*) FILTER (greatest(auc, 1 - auc) >= 0.85) AS passed, count(auc) AS measured FROM auc2",
    "burst_envelope": f"WITH {_burst('documents')} SELECT * FROM burst",
    "overuse_words": f"""WITH {CLASSED}, {A}, {B}, {_burst('ca')}, {_burst('cb', 'own')}, x AS (SELECT doc_id, word, k, n::DOUBLE AS n, k / n::DOUBLE AS p FROM ownk WHERE n >= 120 AND k >= 4 AND length(word) >= 3),
y AS (SELECT doc_id, word, k, greatest(0, ((p + 3.8416 / (2 * n)) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n)) * 1e6 AS lo FROM x)
SELECT doc_id, word, k AS n_word, round(lo, 3) AS lower_pm, burst FROM y JOIN burst USING (word) WHERE lo > 1.2 * burst""",
    "seam_bigrams": f"WITH {_seams('documents', 'sm')} SELECT * FROM sm WHERE n >= 2",
    "unattested_seams": f"WITH {CLASSED}, {A}, {B}, {_seams('ca', 'sa')}, {_seams('cb', 'sb')} SELECT * FROM sb ANTI JOIN sa USING (\"left\", \"right\")",
    "seam_attested": f"WITH {CLASSED}, {A}, {B}, {_seams('ca', 'sa')}, {_seams('cb', 'sb')} SELECT * FROM sb SEMI JOIN sa USING (\"left\", \"right\")",
    "dms_curve": f"WITH {DMS} SELECT * FROM dms",
    "dms_doc_report": f"WITH {DMS} SELECT doc_id, round(avg(m), 6) AS mean_match, count(*) AS n_tokens FROM dms GROUP BY 1",
    "dms_runs": f"""WITH {DMS}, x AS (SELECT *, tok_ix - row_number() OVER (PARTITION BY doc_id ORDER BY tok_ix) AS gr FROM dms WHERE m >= 2),
y AS (SELECT *, min(CASE WHEN m >= 3 THEN tok_ix END) OVER (PARTITION BY doc_id, gr) AS f FROM x)
SELECT doc_id, min(tok_ix) AS start_ix, max(tok_ix) + 1 AS end_ix, sum(m)::BIGINT AS score FROM y WHERE tok_ix >= f GROUP BY doc_id, gr HAVING count(*) >= 2""",
    "literal_spans": f"WITH {LIT} SELECT * FROM lit",
    "regex_spans": f"""WITH p(frame_id, pattern) AS (VALUES ('r.open', '^The [a-z]+'), ('r.end', '[a-z]+tion[.]'), ('r.pair', 'of the')), x AS (SELECT doc_id, {_sent(TX)} AS s FROM documents), y AS (SELECT doc_id, unnest(range(0, len(s))) AS sent_ix, unnest(s) AS s FROM x)
SELECT doc_id, sent_ix, frame_id, len(regexp_extract_all(s, pattern)) AS n FROM y, p WHERE regexp_matches(s, pattern)""",
    "merge_spans": f"WITH {TWO}, u AS (SELECT DISTINCT * FROM two) SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY \"start\", \"end\", channel, frame_id) AS ix FROM u",
    "tell_counts": f"WITH {TWO} SELECT doc_id, channel, count(*) AS n FROM two GROUP BY 1, 2",
    "span_islands": f"""WITH {TWO}, x AS (SELECT *, "end" - "start" AS score, max("end") OVER (PARTITION BY doc_id ORDER BY "start", "end", frame_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM (SELECT DISTINCT doc_id, "start", "end", frame_id FROM two)),
y AS (SELECT *, sum(CASE WHEN reach IS NULL OR "start" > reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY "start", "end", frame_id ROWS UNBOUNDED PRECEDING) AS isl FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY doc_id, isl ORDER BY score DESC, "start", "end", frame_id) AS k FROM y)
SELECT doc_id, min("start") AS "start", max("end") AS "end", max(CASE WHEN k = 1 THEN frame_id END) AS frame_id FROM z GROUP BY doc_id, isl""",
    "resolve_patches": f"WITH RECURSIVE {RESOLVED} SELECT * FROM res",
    "apply_patches": f"""WITH RECURSIVE {RESOLVED}, q AS (SELECT doc_id, "start", "end", replacement, coalesce(lag("end") OVER (PARTITION BY doc_id ORDER BY "start"), 0) AS p FROM res),
s AS (SELECT q.doc_id, string_agg(substr(text, p + 1, "start" - p) || replacement, '' ORDER BY "start") AS body, max("end") AS e FROM q JOIN documents USING (doc_id) GROUP BY 1),
f AS (SELECT d.doc_id, CASE WHEN s.doc_id IS NULL THEN text ELSE body || substr(text, e + 1) END AS x FROM documents d LEFT JOIN s USING (doc_id))
SELECT doc_id, sha256(x) AS fixed_sha256, length(x) AS n_chars FROM f""",
    "line_col": f"""WITH {LIT}, x AS (SELECT lit.doc_id, "start", substr(text, 1, "start") AS h FROM lit JOIN documents USING (doc_id)) SELECT doc_id, "start", (length(h) - length(replace(h, chr(10), '')) + 1)::INT AS line, (length(string_split(h, chr(10))[-1]) + 1)::INT AS col, strlen(h) AS byte_start FROM x""",
    "probe_counts": f"WITH x AS (SELECT doc_id, '␟' || array_to_string({_k2(TX)}, '␟␟') || '␟' AS j FROM documents) SELECT doc_id, len(regexp_extract_all(j, '␟of␟␟the␟')) AS of_the, len(regexp_extract_all(j, '␟the␟')) AS the, len(regexp_extract_all(j, '␟[,]␟␟the␟')) AS comma_the FROM x",
    "wilson_arming": f"""WITH s AS (SELECT doc_id, len(w)::DOUBLE AS n, len(list_distinct(w)) AS k FROM (SELECT doc_id, list_filter({_k2(TX)}, lambda x: x NOT IN {PUNCT}) AS w FROM documents)), p AS (SELECT doc_id, n, k / n AS p FROM s),
q AS (SELECT doc_id, n, p + 3.8416 / (2 * n) AS mid, 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n)) AS half, 1 + 3.8416 / n AS d FROM p)
SELECT doc_id, CASE WHEN n > 0 THEN round(greatest(0.0, (mid - half) / d), 6) ELSE 0.0 END AS lower, CASE WHEN n > 0 THEN round(least(1.0, (mid + half) / d), 6) ELSE 0.0 END AS upper FROM q""",
    "pivot_budget": f"""WITH {LIT}, w AS (SELECT doc_id, len({_ws(TX)}) AS n FROM documents), x AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY "start", "end") AS k FROM lit JOIN w USING (doc_id)) SELECT doc_id, "start", "end" FROM x WHERE k <= ceil(n * 5.0 / 1000)""",
    "boilerplate_lines": f"SELECT doc_id, sha256(array_to_string(list_filter(string_split({TX}, chr(10)), lambda x: NOT regexp_matches(x, '^\\s*(?:\\[?!\\[[^\\]]*\\]\\([^)]*\\)\\]?(?:\\([^)]*\\))?\\s*)+$') AND NOT regexp_matches(x, '^\\s*<img[^>]*>\\s*$') AND NOT regexp_matches(x, '^\\s*</?(?:div|p|center|a|br|details|summary)[^>]*>\\s*$')), chr(10))) AS kept_sha256 FROM documents",
    "manifest_validate": """WITH m AS (SELECT doc_id, doc_id::VARCHAR AS id, CASE WHEN doc_id % 40 = 3 THEN NULL ELSE lang END AS lang, doc_id % 2 = 0 AS human, doc_id % 30 = 0 AS model, doc_id % 50 = 7 AS bad FROM documents), x AS (SELECT * FROM m UNION ALL SELECT * FROM m WHERE doc_id % 60 = 1)
SELECT id, 'duplicate id' AS problem FROM x GROUP BY id HAVING count(*) > 1 UNION ALL SELECT id, 'digest' FROM x WHERE bad UNION ALL SELECT id, 'language' FROM x WHERE lang IS NULL UNION ALL SELECT id, 'model of a human text' FROM x WHERE human AND model""",
    "adjudicate_verdicts": f"WITH {VERDICT} SELECT * FROM vd",
    "verdict_matrix": f"WITH {VERDICT} SELECT (length(ngram) % 3)::INT AS bucket, count(*) FILTER (verdict = 'confirmed') AS confirmed, count(*) FILTER (verdict = 'direction-error') AS direction_error, count(*) FILTER (verdict = 'weak') AS weak, count(*) FILTER (verdict = 'none') AS none_found FROM vd GROUP BY 1",
    "generation_plan": "SELECT n_name AS model, r_name AS prompt_id, s::INT AS slice, substr(sha256(n_name || '|' || r_name || '|' || s), 1, 16) AS seed FROM nation, region, range(0, 2) x(s)",
    "block_kinds": r"""WITH x AS (SELECT doc_id, unnest(string_split(regexp_replace(coalesce(text, ''), '^---\n(?s:.*?)\n(?:---|\.\.\.)\n', ''), chr(10))) AS l FROM documents), y AS (SELECT doc_id, CASE WHEN trim(l) = '' THEN 'blank' WHEN regexp_matches(l, '^ {0,3}#{1,6} ') THEN 'heading' WHEN regexp_matches(l, '^ {0,3}(?:```|~~~)') THEN 'fence' WHEN regexp_matches(l, '^ {0,3}>') THEN 'quote'
WHEN regexp_matches(l, '^\s*[-*+] ') THEN 'bullet' WHEN regexp_matches(l, '^\s*[0-9]{1,9}[.)] ') THEN 'ordered' WHEN contains(l, ' | ') THEN 'table' ELSE 'text' END AS kind FROM x) SELECT doc_id, kind, count(*) AS n FROM y GROUP BY 1, 2""",
    "previous_opener": f"WITH {OPEN}, x AS (SELECT doc_id, len(list_filter(range(2, len(o) + 1), lambda i: o[i] = o[i - 1])) AS n FROM o) SELECT * FROM x WHERE n > 0",
    "speaker_log_odds": f"WITH c AS (SELECT text, CASE WHEN role = 'user' THEN 'a' ELSE 'b' END AS class FROM conversations WHERE role IN ('user', 'assistant')), {_grams(1)}, {TOT}, {LOGODDS} SELECT ngram, a, b, round(delta, 6) AS delta, round(delta / se, 6) AS z FROM z WHERE a + b >= 5",
    "html_prose": r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?s)<!--.*?-->', ' ', 'g'),
'(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<head\b.*?</head\s*>|<noscript\b.*?</noscript\s*>|<template\b.*?</template\s*>', ' ', 'g'), '(?s)\{\{.*?\}\}|\{%.*?%\}|<%.*?%>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'),
'&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')) AS prose FROM pages""",
    "event_rates": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2",
}
