"""Small scalar rules over names, tags, digests and ranges; null in, null out."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_hash(c: Column) -> Column:
    """The first 8 bytes of sha256 as an unsigned number, decimal(20,0)."""
    return F.conv(F.substring(F.sha2(c, 256), 1, 16), 16, 10).cast("decimal(20,0)")


def coarse_tag(tag: Column) -> Column:
    """The first two characters of a tag that begins with a letter; punctuation tags as they are."""
    return F.when(tag.rlike(r"^\p{L}"), F.substring(tag, 1, 2)).otherwise(tag)


def frame_prefix(frame_id: Column) -> Column:
    """What stands before the first full stop."""
    return F.substring_index(frame_id, ".", 1)


def suffix_reductions(word: Column) -> Column:
    """Candidate base forms of a lower-case word, more than are words: -ied, -ed and -ing, -ies, -es, -s; none repeated."""

    def cut(suffix: str, last: str = "") -> Column:
        stem = word.substr(F.lit(1), F.length(word) - len(suffix))
        return F.when(word.endswith(suffix), F.concat(stem, F.lit(last)))

    def undoubled(suffix: str) -> Column:
        return F.when(word.rlike(rf"([^aeiou])\1{suffix}$"), word.substr(F.lit(1), F.length(word) - len(suffix) - 1))

    forms = [cut("ied", "y")]
    for suffix in ("ed", "ing"):
        forms += [undoubled(suffix), cut(suffix), cut(suffix, "e")]
    forms += [cut("ies", "y"), cut("es"), cut("s")]
    return F.array_distinct(F.array_compact(F.array(*forms)))


def family_of(model: Column) -> Column:
    """Family of a model's name; an unknown name is an error, so that none is left out of counts unseen."""
    low = F.lower(model)
    found = F.when(model.isNull(), None)
    for name in ("qwen", "gemma", "llama", "granite"):
        found = found.when(low.contains(name), name)
    return found.when(low.rlike("claude|opus|sonnet"), "claude").otherwise(F.raise_error(F.concat(F.lit("no family for model: "), model)))


def literal_phrase(pattern: str) -> str | None:
    """The phrase of a pattern that is nothing but bounded words, in lower case; None for all other patterns."""
    m = re.fullmatch(r"(?:\(\?i\))?(?:\\b)?([A-Za-z']+(?: [A-Za-z']+)*)(?:\\b|\\s\+)", pattern)
    return m[1].lower() if m else None


def contains(outer_start: Column, outer_end: Column, start: Column, end: Column) -> Column:
    return (outer_start <= start) & (end <= outer_end)


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Half-open ranges share a position."""
    return (a_start < b_end) & (b_start < a_end)


def slice_of(text: Column, start: Column, end: Column) -> Column:
    return text.substr(start + 1, end - start)
