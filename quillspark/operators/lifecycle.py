"""Corpus lifecycle beyond statistics: normalisation, length, paths, sealing, vocabularies, calibration, closure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# The named references that are decoded.
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0", "mdash": "—", "ndash": "–", "hellip": "…",
    "rsquo": "’", "lsquo": "‘", "rdquo": "”", "ldquo": "“",
}
#: References in at most 32 characters between & and ;, as many as can name a character.
REFERENCE = "&(?:" + "|".join(ENTITIES) + r"|#\+?[0-9]{1,30}|#[xX]\+?[0-9a-fA-F]{1,29});"
PASSES = 4
FEWEST, MOST = 300, 2000


def _decoded(ref: Column) -> Column:
    """The character of one reference; as it is if its number is no character."""
    table = F.create_map(*[F.lit(x) for k, v in ENTITIES.items() for x in (f"&{k};", v)])
    digits = F.regexp_extract(ref, r"^&#[xX]?\+?0*([0-9a-fA-F]*);$", 1)
    base = F.when(ref.rlike("^&#[xX]"), F.conv(digits, 16, 10)).otherwise(F.conv(digits, 10, 10))
    # more than 8 digits without leading zeros is beyond every code point; conv need not be asked
    code = F.when(digits == "", F.lit(0)).when(F.length(digits) <= 8, base.cast("long"))
    valid = (code < 0xD800) | ((code > 0xDFFF) & (code <= 0x10FFFF))
    char = F.decode(F.unhex(F.lpad(F.hex(F.when(valid, code)), 8, "0")), "UTF-32")
    return F.when(ref.startswith("&#"), F.coalesce(char, ref)).otherwise(table[ref])


def normalised(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the column's line ends as \\n and character references decoded, up to four times over; null is empty."""
    t = F.col(text_col)
    d = docs.withColumn(text_col, F.replace(F.replace(F.coalesce(t, F.lit("")), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")))
    for _ in range(PASSES):
        d = d.withColumn("_r", F.regexp_extract_all(t, F.lit(REFERENCE), F.lit(0))).withColumn("_g", F.split(t, REFERENCE, -1))
        joined = F.array_join(F.transform("_g", lambda g, i: F.concat(g, F.coalesce(_decoded(F.get("_r", i)), F.lit("")))), "")
        d = d.withColumn(text_col, F.when(F.size("_r") > 0, joined).otherwise(t)).drop("_r", "_g")
    return d


def length_gate(docs: DataFrame, fewest: int = FEWEST, most: int = MOST) -> DataFrame:
    """doc_id, n_words, kept (at least `fewest`), in_range; a null text has no words."""
    n = F.size(T.spaced_words(F.coalesce("text", F.lit("")))).cast("long")
    return docs.select("doc_id", n.alias("n_words"), (n >= fewest).alias("kept"), n.between(fewest, most).alias("in_range"))


def relative_path(cls: Column, genre: Column, doc: Column, license_name: Column) -> Column:
    """Where a record's text is below the corpus folder; share-alike texts are apart from the others."""
    apart = F.coalesce(F.upper(F.trim(license_name)).startswith("CC-BY-SA"), F.lit(False))
    return F.concat_ws("/", F.when(apart, "quarantine").otherwise(cls), genre, F.concat(doc, F.lit(".md")))


def seal(manifest: DataFrame, texts: DataFrame) -> DataFrame:
    """id, sha256, path of the held-out records; texts: id, text. A digest that differs from the text's is an error."""
    held = manifest.where("split = 'holdout'").join(texts.select("id", F.sha2("text", 256).alias("now")), "id", "left")
    stale = F.raise_error(F.concat(F.lit("stale manifest: "), "id"))
    same = F.coalesce(F.col("now") == F.col("sha256"), F.lit(False))
    return held.select("id", F.when(same, F.col("sha256")).otherwise(stale).alias("sha256"), relative_path(F.col("class"), F.col("genre"), F.col("id"), F.col("license")).alias("path"))


def holdout_check(lock: DataFrame, manifest: DataFrame, texts: DataFrame) -> DataFrame:
    """id, problem of each disagreement between the lock (id, sha256, path), the manifest and the texts (id, text)."""
    m = manifest.select("id", F.col("split").alias("m_split"), F.col("sha256").alias("m_sha"), F.lit(True).alias("in_manifest"))
    t = texts.select("id", F.sha2("text", 256).alias("t_sha"))
    j = lock.select("id", "sha256", F.lit(True).alias("in_lock")).join(m, "id", "full").join(t, "id", "left")
    locked, known = F.col("in_lock").isNotNull(), F.col("in_manifest").isNotNull()
    checks = [
        (locked & F.col("t_sha").isNull(), "missing text"),
        (locked & (F.col("t_sha") != F.col("sha256")), "text digest"),
        (locked & ~known, "not in manifest"),
        (locked & known & ~F.col("m_split").eqNullSafe(F.lit("holdout")), "split"),
        (locked & known & ~F.col("m_sha").eqNullSafe(F.col("sha256")), "manifest digest"),
        (~locked & F.col("m_split").eqNullSafe(F.lit("holdout")), "not in lock"),
    ]
    found = F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in checks]))
    return j.select("id", F.explode(found).alias("problem"))


def vocabulary(docs: DataFrame) -> DataFrame:
    """token, n, id: clean tokens with their occurrences and 0-based number in order of token.

    Numbers are places in a lane (the first two characters) and what stands before the lane, so no window holds all tokens.
    """
    t = docs.select(F.explode(T.clean_tokens(F.coalesce("text", F.lit("")))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    t = t.withColumn("lane", F.substring("token", 1, 2))
    k = t.groupBy("lane").agg(F.count("*").alias("k"))
    k = k.select("lane", (F.sum("k").over(Window.orderBy("lane")) - F.col("k")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("lane").orderBy("token")) - 1
    return t.withColumn("inside", inside).join(k, "lane").select("token", "n", (F.col("before") + F.col("inside")).alias("id"))


def edit_ceiling(edits: DataFrame, words: DataFrame, headroom: float = 1.15) -> DataFrame:
    """One row: the largest edits per 1000 words of a document, and that with headroom, rounded up to 0.01.

    edits: a row for each edit (doc_id); words: doc_id, n_words. Documents without words count as 0.
    """
    n = edits.groupBy("doc_id").agg(F.count("*").alias("k"))
    r = words.join(n, "doc_id", "left").select(F.when(F.col("n_words") > 0, F.coalesce("k", F.lit(0)) * 1000.0 / F.col("n_words")).otherwise(0.0).alias("r"))
    top = F.coalesce(F.max("r"), F.lit(0.0))
    return r.agg(F.round(top, 6).alias("max_rate"), (F.ceil(top * headroom * 100) / 100).alias("ceiling"))


def touched(before_after: DataFrame, keys: list[str]) -> DataFrame:
    """Documents, sentences, and the share of sentences that edits changed, by keys with totals; rows: *keys, before, after."""
    s = T.sentences(F.coalesce("before", F.lit("")))
    d = before_after.select(*keys, s.alias("s"), F.array_distinct(T.sentences(F.coalesce("after", F.lit("")))).alias("a"))
    gone = F.array_except("s", "a")
    d = d.select(*keys, F.size("s").alias("n"), F.size(F.filter("s", lambda x: F.array_contains(gone, x))).alias("k"))
    g = d.rollup(*keys).agg(F.count("*").alias("docs"), F.sum("n").alias("sentences"), F.sum("k").alias("k"))
    return g.select(*keys, "docs", "sentences", F.round(F.when(F.col("sentences") > 0, F.col("k") / F.col("sentences")).otherwise(0.0), 6).alias("touched"))


def excess_words(pairs: DataFrame, licensed: Column | None = None) -> DataFrame:
    """doc_id, excess: words that an output has more often than its input and the licensed words together, sorted.

    pairs: doc_id, input, output. licensed: an array of words, each as often as it may be added.
    """
    words = lambda c: F.filter(T.clean_tokens(F.coalesce(c, F.lit(""))), lambda x: ~x.isin(*".,;:!?"))
    allowed = words(F.col("input")) if licensed is None else F.concat(words(F.col("input")), F.coalesce(licensed, F.array().cast("array<string>")))
    d = pairs.select("doc_id", F.monotonically_increasing_id().alias("row"), allowed.alias("a"), words(F.col("output")).alias("o"))
    e = d.select("doc_id", "row", F.explode_outer(F.concat(F.transform("a", lambda x: F.struct(x.alias("w"), F.lit(-1).alias("k"))), F.transform("o", lambda x: F.struct(x.alias("w"), F.lit(1).alias("k"))))).alias("x"))
    c = e.groupBy("doc_id", "row", "x.w").agg(F.sum("x.k").alias("k"))
    return c.groupBy("doc_id", "row").agg(F.array_sort(F.collect_list(F.when(F.col("k") > 0, F.col("w")))).alias("excess")).drop("row")


def summary(values: DataFrame) -> DataFrame:
    """Mean and median (of two middle values their mean) of v by genre, class and metric."""
    return values.groupBy("genre", "class", "metric").agg(F.count("v").alias("n"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.expr("percentile(v, 0.5)"), 6).alias("median"))


def pooled_rate(a: Column, total_a: Column, b: Column, total_b: Column) -> Column:
    """Occurrences per million over two corpora taken together; 0 where both are empty."""
    n = total_a + total_b
    return F.when(n > 0, (a + b) * 1e6 / n).otherwise(0.0)


def best_rate(a: Column, total_a: Column, b: Column, total_b: Column) -> Column:
    """The larger of the rates per million in each corpus alone."""
    rate = lambda k, n: F.when(n > 0, k * 1e6 / n).otherwise(0.0)
    return F.greatest(rate(a, total_a), rate(b, total_b))
