"""Blocks of markdown texts: native line classification, and a line-state parser for nested constructs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import workers_import

FRONT = r"^---\n(?s:.*?)\n(?:---|\.\.\.)\n"


def without_front_matter(text):
    return F.regexp_replace(text, FRONT, "")


def line_kinds(docs: DataFrame) -> DataFrame:
    """doc_id, line_ix, kind of each line of the text without front matter."""
    d = docs.select("doc_id", F.posexplode(F.split(without_front_matter(F.coalesce("text", F.lit(""))), "\n", -1)).alias("line_ix", "line"))
    x = F.col("line")
    kind = (
        F.when(F.trim(x) == "", "blank").when(x.rlike(r"^ {0,3}#{1,6} "), "heading").when(x.rlike(r"^ {0,3}(?:```|~~~)"), "fence").when(x.rlike(r"^ {0,3}>"), "quote")
        .when(x.rlike(r"^\s*[-*+] "), "bullet").when(x.rlike(r"^\s*[0-9]{1,9}[.)] "), "ordered").when(x.contains(" | "), "table").otherwise("text")
    )
    return d.select("doc_id", "line_ix", kind.alias("kind"))


def blocks_of(text: str) -> list[tuple[str, int, int, int]]:
    """(kind, level, start, end) of blocks in order; code fences hide what they hold; paragraphs run until another kind."""
    import re

    out: list[tuple[str, int, int, int]] = []
    at, fence, open_kind = 0, None, None
    m = re.match(r"---\n.*?\n(?:---|\.\.\.)\n", text, re.S)
    if m:
        out.append(("front_matter", 0, 0, m.end()))
        at = m.end()
    for line in text[at:].splitlines(keepends=True):
        body, start, at = line.rstrip("\r\n"), at, at + len(line)
        end = start + len(body)
        if fence:
            k, lv, s, _ = out[-1]
            out[-1] = (k, lv, s, end)
            if body.strip().startswith(fence) and not body.strip().strip(fence[0]):
                fence, open_kind = None, None
            continue
        f = re.match(r" {0,3}(```+|~~~+)", body)
        h = re.match(r" {0,3}(#{1,6})(?: |$)", body)
        li = re.match(r"(\s*)(?:[-*+]|\d{1,9}[.)]) ", body)
        if f:
            fence, open_kind = f[1], "code"
            out.append(("code", 0, start, end))
        elif not body.strip():
            open_kind = None
        elif h:
            out.append(("heading", len(h[1]), start, end))
            open_kind = None
        elif li:
            out.append(("item", len(li[1]) // 2, start, end))
            open_kind = "item"
        elif re.match(r" {0,3}>", body):
            if open_kind == "quote":
                out[-1] = ("quote", 0, out[-1][2], end)
            else:
                out.append(("quote", 0, start, end))
            open_kind = "quote"
        elif re.match(r"\s*\|.*\|\s*$", body):
            if open_kind == "table":
                out[-1] = ("table", 0, out[-1][2], end)
            else:
                out.append(("table", 0, start, end))
            open_kind = "table"
        elif open_kind in ("paragraph", "item", "quote"):
            k, lv, s, _ = out[-1]
            out[-1] = (k, lv, s, end)
        else:
            out.append(("paragraph", 0, start, end))
            open_kind = "paragraph"
    return out


def blocks(docs: DataFrame) -> DataFrame:
    """doc_id, block_ix, kind, level, start, end."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = [(d, k, *b) for d, t in zip(p["doc_id"], p["text"], strict=True) for k, b in enumerate(blocks_of(t or ""))]
            yield pd.DataFrame(rows, columns=["doc_id", "block_ix", "kind", "level", "start", "end"])

    workers_import(docs.sparkSession)
    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, block_ix int, kind string, level int, start int, end int")


def html_prose(pages: DataFrame) -> DataFrame:
    """page_id, prose: visible text by markup stripping: no head, script, style, comments; tags as spaces; named references decoded."""
    t = F.coalesce(F.col("html"), F.lit(""))
    for p in (r"(?s)<!--.*?-->", r"(?is)<(script|style|head|noscript|template)\b.*?</\1\s*>", r"(?s)\{\{.*?\}\}|\{%.*?%\}|<%.*?%>", r"(?s)<[^>]*>"):
        t = F.regexp_replace(t, p, " ")
    for name, c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(c))
    return pages.select("page_id", F.trim(F.regexp_replace(t, r"\s+", " ")).alias("prose"))
