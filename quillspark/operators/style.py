"""Document metrics that need no tagger, as one vector per document. Arrays inside the row; nothing is shuffled.

A paragraph is a part of the text between blank lines that has a sentence. A null text counts as empty, and every metric of
an empty text is 0. Fenced code is left out. Letters fold case in ASCII only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.stats import rate
from .metrics import _mean_sd

# Openers of sentences that connect them to what stands before.
DISCOURSE_MARKERS = [
    "Additionally", "Consequently", "Conversely", "Finally", "Firstly", "Furthermore", "However", "Importantly", "In conclusion", "In fact",
    "In other words", "In short", "In summary", "Indeed", "It is important to note", "It's worth noting", "Lastly", "Likewise", "Meanwhile",
    "Moreover", "Nevertheless", "Nonetheless", "Notably", "Overall", "Similarly", "Specifically", "Subsequently", "That said", "Therefore",
    "Thus", "To summarize", "Ultimately",
]

# Phrases that open or close a paragraph by ritual.
RITUAL_MARKERS = [
    "As we can see", "At the end of the day", "In closing", "In conclusion", "In summary", "In today's digital age",
    "In today's fast-paced world", "In today's world", "Looking ahead", "Overall", "To conclude", "To sum up", "To summarize", "To wrap up",
    "Ultimately",
]

# What can be contracted, and the contraction.
CONTRACTIONS = {
    "cannot": "can't", "could not": "couldn't", "did not": "didn't", "do not": "don't", "does not": "doesn't", "had not": "hadn't",
    "has not": "hasn't", "have not": "haven't", "he is": "he's", "i am": "i'm", "i have": "i've", "i will": "i'll", "is not": "isn't",
    "it is": "it's", "must not": "mustn't", "she is": "she's", "should not": "shouldn't", "that is": "that's", "they are": "they're",
    "they will": "they'll", "was not": "wasn't", "we are": "we're", "we will": "we'll", "were not": "weren't", "will not": "won't",
    "would not": "wouldn't", "you are": "you're", "you will": "you'll",
}

NOT_JUST_BUT = r"(?is)\bnot\s+(?:just|only)\b.*?\bbut\b"
#: A fence hides all lines up to one of its kind, or the rest of the text.
FENCES = (r"(?ms)^ {0,3}```.*?(?:^ {0,3}```[^\n]*$|\z)", r"(?ms)^ {0,3}~~~.*?(?:^ {0,3}~~~[^\n]*$|\z)")
HEADING, ITEM = r"^ {0,3}#{1,6}(?: |$)", r"^\s*(?:[-*+]|[0-9]{1,9}[.)]) "


def opener_pattern(markers: list[str]) -> str:
    """Matches a folded sentence that opens with a marker, emphasis marks and white space before it aside."""
    return r"^[\s*_]*(?:" + "|".join(m.lower().replace("'", "['’]") for m in markers) + r")(?:[^\p{L}\p{N}]|$)"


def without_fences(text: Column) -> Column:
    for p in FENCES:
        text = F.regexp_replace(text, p, "")
    return text


def paragraphs(text: Column) -> Column:
    """Arrays of the sentences of each paragraph; what is white space alone is no sentence."""
    units = F.transform(F.split(text, r"\n[ \t\r]*\n", -1), lambda u: F.filter(T.sentences(u), lambda s: s.rlike(r"[^ \t\r\n]")))
    return F.filter(units, lambda s: F.size(s) > 0)


def em_dashes(text: Column) -> Column:
    """Em dashes, and pairs of hyphens (no more, no less) between letters or digits, with a space on each side at most."""
    # letters and digits are doubled, so that one can stand after a pair and before the next
    doubled = F.regexp_replace(text, r"([\p{L}\p{N}])", "$1$1")
    return F.regexp_count(text, F.lit("—")) + F.regexp_count(doubled, F.lit(r"[\p{L}\p{N}] ?-- ?[\p{L}\p{N}]"))


def vector(docs: DataFrame) -> DataFrame:
    """doc_id and the metrics, rounded to 6 places; one row for each row of docs."""
    d = docs.select("doc_id", without_fences(F.coalesce("text", F.lit(""))).alias("t"))
    d = d.withColumn("p", paragraphs(F.col("t"))).withColumn("s", F.flatten("p"))
    d = d.withColumn("w", F.transform("s", lambda s: T.metric_words(s))).withColumn("n", F.size(F.flatten("w")))
    d = d.withColumn("spaced", F.size(T.spaced_words(F.col("t"))))
    d = d.withColumn("shape", F.transform("p", lambda s: F.size(s).cast("double")))
    mean, _, cv = _mean_sd(F.col("shape"))
    ritual, marker = opener_pattern(RITUAL_MARKERS), opener_pattern(DISCOURSE_MARKERS)
    opens = lambda s, p: T.ascii_lower(s).rlike(p)
    bookends = F.size(F.filter("p", lambda s: opens(F.get(s, F.lit(0)), ritual) | opens(F.element_at(s, -1), ritual)))
    one_word = [k for k in CONTRACTIONS if " " not in k]
    two_words = [k for k in CONTRACTIONS if " " in k]
    contracted = F.size(F.filter(F.flatten("w"), lambda x: x.isin(*CONTRACTIONS.values())))
    open_forms = F.size(F.filter(F.flatten("w"), lambda x: x.isin(*one_word))) + F.size(F.filter(F.flatten(F.transform("w", lambda s: T.ngrams(s, 2))), lambda x: x.isin(*two_words)))
    d = d.withColumn("short", contracted).withColumn("long", open_forms)
    lines = F.split("t", "\n", -1)
    per_words = lambda k: F.round(rate(k, F.col("n"), 1000.0), 6)
    share = lambda k, n: F.round(F.when(n > 0, k / n).otherwise(0.0), 6)
    return d.select(
        "doc_id",
        F.round(mean, 6).alias("paragraph_shape_mean"),
        F.round(cv, 6).alias("paragraph_shape_cv"),
        F.round(rate(em_dashes(F.col("t")), F.col("spaced"), 1000.0), 6).alias("em_dash_density"),
        per_words(F.size(F.filter("s", lambda s: opens(s, marker)))).alias("discourse_marker_density"),
        share(F.col("short"), F.col("short") + F.col("long")).alias("contraction_ratio"),
        share(bookends, F.size("p")).alias("ritual_marker_rate"),
        share(F.size(F.filter("s", lambda s: s.rlike(NOT_JUST_BUT))), F.size("s")).alias("not_just_but_rate"),
        per_words(F.size(F.filter(lines, lambda x: x.rlike(HEADING)))).alias("heading_density"),
        per_words(F.size(F.filter(lines, lambda x: x.rlike(ITEM)))).alias("list_item_density"),
    )
