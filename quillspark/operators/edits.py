"""Edit operators: candidates with gates, patches, bounded passes. Tables of phrases are arguments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans as S


def in_quotes(text: Column, start: Column, end: Column) -> Column:
    """Odd number of straight quotes before, an open curly quote, or a quote inside."""
    head = text.substr(F.lit(1), start)
    count = lambda q: F.length(head) - F.length(F.replace(head, F.lit(q), F.lit("")))
    inside = text.substr(start + 1, end - start).rlike('["“”]')
    # most texts have no quote: what stands before a span is looked at in the others alone
    quoted = ((count('"') % 2) == 1) | (count("“") > count("”")) | inside
    return F.when(text.contains('"') | text.contains("“") | text.contains("”"), quoted).otherwise(False)


def deletions(docs: DataFrame, phrases: list[str], seams: DataFrame, rule: str = "span.delete") -> DataFrame:
    """Patches that delete a phrase and one space after it, outside quotes, where the words that then meet are attested.

    seams: left, right. A sentence start or a full stop on the right needs no attestation. A letter that a deletion at a
    sentence start exposes becomes a capital, as part of the patch; no other letter changes.
    """
    found = S.literal_spans(docs, phrases, keep=("text",))
    t = F.col("text")
    before = t.substr(F.lit(1), F.col("start"))
    after = t.substr(F.col("end") + 1, F.length(t))
    # anchored, with a greedy run first: the search begins at the end of what stands before
    word = F.regexp_extract(before, r"(?s)^(?:.*[^\p{L}'])?([\p{L}']+)\s*$", 1)
    left = F.lower(F.when(word != "", word).otherwise(F.regexp_extract(before, r"(?s)^.*([.,;:!?])\s*$", 1)))
    right = F.lower(F.regexp_extract(after, r"^\s*([\p{L}']+|[.,;:!?])", 1))
    space = (t.substr(F.col("end") + 1, F.lit(1)) == " ").cast("int")
    first = t.substr(F.col("end") + space + 1, F.lit(1))
    c = found.where(~in_quotes(t, F.col("start"), F.col("end"))).select("doc_id", "start", (F.col("end") + space).alias("end"), left.alias("left"), right.alias("right"), first.alias("first"))
    opens = (F.col("left") == "") | F.col("left").isin(".", "!", "?")
    safe = opens | (F.col("right") == ".")
    ok = c.where(safe).unionByName(c.where(~safe).join(seams.select("left", "right").distinct(), ["left", "right"], "left_semi").select(*c.columns))
    exposed = opens & F.col("first").rlike(r"\p{Ll}")
    end = F.col("end") + F.when(exposed, 1).otherwise(0)
    return ok.select("doc_id", "start", end.alias("end"), F.lit(rule).alias("rule"), F.when(exposed, F.upper("first")).otherwise("").alias("replacement"))


def substitutions(docs: DataFrame, pairs: dict[str, str], rule: str = "sub.apply") -> DataFrame:
    """Patches that replace phrases, with the capital of what they replace, outside quotes."""
    table = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    found = S.literal_spans(docs, list(pairs), keep=("text",))
    t = F.col("text")
    old, new = t.substr(F.col("start") + 1, F.lit(1)), table[F.col("frame_id")]
    kept = F.when(old == F.lower(old), new).otherwise(F.concat(F.upper(new.substr(1, 1)), new.substr(F.lit(2), F.length(new))))
    return found.where(~in_quotes(t, F.col("start"), F.col("end"))).select("doc_id", "start", "end", F.lit(rule).alias("rule"), kept.alias("replacement"))


def fix(docs: DataFrame, delete: list[str], swap: dict[str, str], seams: DataFrame, passes: int = 2) -> DataFrame:
    """doc_id, text after `passes` passes of all patches, resolved and applied; the passes are unrolled in one plan."""
    d = docs.select("doc_id", "text")
    for _ in range(passes):
        patches = substitutions(d, swap).unionByName(deletions(d, delete, seams))
        d = S.apply_patches(d, S.resolve(patches)).select("doc_id", F.col("fixed").alias("text"))
    return d
