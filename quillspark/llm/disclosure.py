"""Operator 2: information-theoretic sanitisation of personal data, in DataFrame functions alone.

Protected entities are e-mail addresses, IP addresses, card numbers and phone numbers, found by pattern and check digit.
A term is a run of letters and digits in lower case. Over the whole corpus, n_e documents have entity e, n_et of them have
term t too, anywhere outside their entities, df_t have t anywhere, N are all. IC(e) = -ln(n_e / N) is what e is worth,
PMI(e; t) = IC(e) + ln(n_et / df_t) is what t tells of it. t discloses e if PMI >= alpha * IC, however few documents have
e: a term of those documents alone tells all of it. With support = z > 0, the lower bound of the share n_et / df_t, z standard
deviations below (Wilson), stands for the share, so that one document of two or three with t tells little. Disclosing terms
are spans of kind `term` in every text that has them; sanitise() generalises entities to their kind and terms to [TERM].

Positions: a pattern's matches and the gaps between them, whose lengths are summed in groups. Patterns are possessive or anchored to the
start of a run where that changes no match, so that no text makes them quadratic or deep. As n_et <= n_e, a term of more
than n_e^alpha * N^(1 - alpha) documents discloses no e: it goes before pairs are made. Entities of the same documents have
the same counts, so one of them stands for all. Terms looked for in the corpus are broadcast if they are counted to be at
most MOST_TERMS, their hashes (16 bytes each) up to MOST_HASHES, documents' hits if they are as few and have at most MOST_BYTES; else they are joined by shuffle.

Defined cases: null text is empty; no finds: counts 0 and the digest of the empty string; repeated rows give repeated
results and count as documents; null doc_id is an id like another; empty table: empty result; other columns: kept by
sanitise(), not read by find().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.spans import CHUNK, located
from .common import pick, saved, text_or_empty

KINDS = ("email", "ip", "card", "phone")
#: find: Java's dialect, with the same matches as the plain patterns
#:   email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+       ip [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#:   card [0-9]([\x20-]?[0-9])+                                    phone \+[0-9][\x20().0-9-]+[0-9]
FIND = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
ALPHA, MOST_TERMS, MOST_HASHES, MOST_BYTES = 0.9, 200_000, 4_000_000, 64 << 20
#: Code points of a block of a text that is rewritten.
BLOCK = 1024
NOT_TERM = r"[^\p{L}\p{N}]+"


def _maybe(kind: str, t: Column) -> Column:
    """False only for texts without a match."""
    return {"email": t.contains("@"), "ip": t.rlike(r"[0-9]\.[0-9]"), "card": t.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"), "phone": t.contains("+")}[kind]


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    d = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: (F.substring(F.reverse(digits), i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)))
    return F.aggregate(d, F.lit(0), lambda a, v: a + F.when(v > 9, v - 9).otherwise(v)) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return ~F.exists(F.split(m, r"\."), lambda p: ~p.rlike("^0*(?:[0-9]{0,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"))
    n = F.length(_digits(m))
    if kind == "card":
        return n.between(16, 19) & _luhn(_digits(m))
    return n.between(8, 15)


def _found(d: DataFrame, kind: str, text: Column, pattern: str | Column) -> DataFrame:
    """Adds the column kind: array of (s, e, v) of a pattern's matches in text, in code points."""
    d = located(d.withColumn("_t", text), "_t", pattern)
    spans = F.transform("found", lambda x: F.struct(x["start"].cast("long").alias("s"), x["end"].cast("long").alias("e"), x["v"].alias("v")))
    return d.withColumn(kind, spans).drop("_t", "found")


def _all_found(d: DataFrame) -> DataFrame:
    """Adds the columns of all kinds: the valid matches in the column text."""

    def valid(kind: str):
        return lambda x: _valid(kind, x["v"])

    for kind in KINDS:
        d = _found(d, kind, F.when(_maybe(kind, F.col("text")), F.col("text")).otherwise(""), FIND[kind])
        d = d.withColumn(kind, F.filter(kind, valid(kind)))
    return d


def entities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, h (hash of the text), text, and email, ip, card, phone: arrays of (s, e, v)."""
    d = pick(docs, doc_id=id_col, text=text_col).select("doc_id", text_or_empty(F.col("text")).alias("text"))
    d = d.withColumn("h", F.xxhash64("text"))
    return _all_found(d)


def _terms(x: Column) -> Column:
    return F.filter(F.array_distinct(F.split(F.lower(x), NOT_TERM)), lambda w: F.length(w) >= 2)


def _mentioned() -> Column:
    """Array of the distinct entities of a row of entities()."""

    def named(kind: str):
        return lambda x: F.concat(F.lit(kind + ":"), F.lower(x["v"]) if kind in ("email", "ip") else _digits(x["v"]))

    return F.array_distinct(F.concat(*[F.transform(kind, named(kind)) for kind in KINDS]))


def _outside() -> Column:
    """Array of the distinct terms outside the entities of a row of entities(); none if it has no entity."""
    t = F.col("text")
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(t, (acc["at"] + 1).cast("int"), F.greatest(x["s"] - acc["at"], F.lit(0)).cast("int"))
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.array_append(acc["out"], gap).alias("out"))

    whole = F.array_sort(F.concat(*KINDS))
    rest = F.aggregate(whole, begin, step, lambda acc: F.concat(F.array_join(acc["out"], "\n"), F.lit("\n"), F.substring(t, (acc["at"] + 1).cast("int"), F.lit(2147483647))))
    return F.when(F.size(F.concat(*KINDS)) > 0, _terms(rest)).otherwise(F.array().cast("array<string>"))


def _lower(k: Column, n: Column, z: float) -> Column:
    """Lower bound of a share k of n, z standard deviations below it; the share itself if z is 0."""
    p, zz = k / n, z * z
    return (p + zz / (2 * n) - z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n))) / (1 + zz / n)


def disclosing(docs: DataFrame, alpha: float = ALPHA, support: float = 0.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame | None:
    """doc_id, h, ts (disclosing terms in it) of each distinct text that has any; None if there are none."""
    # a row's number is read back as it was written
    base = entities(docs, id_col, text_col).select(F.monotonically_increasing_id().alias("row"), _mentioned().alias("es"), _outside().alias("ts"))
    base = saved(base.where(F.size("es") > 0), "entities")
    seen = base.select("row", F.explode("es").alias("e"))
    total = float(max(docs.count(), 1))
    n_e = seen.groupBy("e").agg(F.count("*").alias("n_e"), F.sum(F.xxhash64("row").cast("decimal(20,0)")).alias("rows"))
    n_e = saved(n_e.where(F.col("n_e") < total).groupBy("n_e", "rows").agg(F.min("e").alias("e")).select("e", "n_e"), "n-e")
    few = n_e.count() <= MOST_TERMS
    members = seen.join(F.broadcast(n_e) if few else n_e, "e")
    # the most documents of a term that can disclose; a little more, for rounding
    most = F.pow(F.col("n_e").cast("double"), F.lit(float(alpha))) * total ** (1 - alpha) * (1 + 1e-9)
    highest = n_e.agg(F.max(most)).first()[0] or 0.0
    ic = -F.log(F.col("n_e") / F.lit(total))

    def told_by(df: str) -> Column:
        k = F.least(F.col("n_et"), F.col(df)).cast("double")
        return (F.log(F.greatest(_lower(k, F.col(df).cast("double"), support), F.lit(1e-300))) + ic >= alpha * ic) & (ic > 0)

    # documents with entities that have t are some of those that have it: a bound that drops what cannot disclose
    held = base.select("row", F.explode("ts").alias("t"))
    near_df = saved(held.groupBy("t").agg(F.count("*").alias("near_df")).where(F.col("near_df") <= highest), "near-df")
    few = near_df.count() <= MOST_TERMS
    rare = held.join(F.broadcast(near_df) if few else near_df, "t")
    pairs = rare.join(members, "row").where(F.col("near_df") <= most).groupBy("e", "t").agg(F.count("*").alias("n_et"), F.first("near_df").alias("near_df"), F.first("n_e").alias("n_e"))
    # of pairs with the same term and as frequent an entity, the one with most documents tells most
    pairs = saved(pairs.where(told_by("near_df")).groupBy("t", "n_e").agg(F.max("n_et").alias("n_et")), "pairs")
    terms = saved(pairs.select("t").distinct(), "terms")
    n_terms = terms.count()
    if not n_terms:
        return None
    # one pass over all texts, with the candidates alone: a row for each row of docs and candidate that it has
    text = pick(docs, doc_id=id_col, text=text_col).select("doc_id", text_or_empty(F.col("text")).alias("text"))
    words = text.select("doc_id", F.xxhash64("text").alias("h"), F.explode(_terms(F.col("text"))).alias("t"))
    if n_terms <= MOST_HASHES:
        # by hash first: a long a term is broadcast, however long the terms; then the few words left by themselves
        words = words.join(F.broadcast(terms.select(F.xxhash64("t").alias("x")).distinct()), F.xxhash64("t") == F.col("x"), "left_semi")
    having = saved(words.join(F.broadcast(terms) if n_terms <= MOST_TERMS else terms, "t"), "having")
    df = having.groupBy("t").agg(F.count("*").alias("df"))
    told = saved(pairs.join(df, "t").where(told_by("df")).select("t").distinct(), "disclosing")
    n_told = told.count()
    if not n_told:
        return None
    hits = having.join(F.broadcast(told) if n_told <= MOST_TERMS else told, "t")
    return saved(hits.groupBy("doc_id", "h").agg(F.array_sort(F.collect_set("t")).alias("ts")), "hits")


def _with_spans(docs: DataFrame, keep: list[Column], alpha: float, support: float, id_col: str, text_col: str) -> DataFrame:
    """keep, doc_id, text, h, and email, ip, card, phone, term: arrays of (s, e, v), for each row.

    Texts are shuffled only if there are more hits than can be broadcast.
    """
    hits = disclosing(docs, alpha, support, id_col, text_col)
    d = docs.select(*keep, F.col(id_col).alias("doc_id"), text_or_empty(F.col(text_col)).alias("text")).withColumn("h", F.xxhash64("text"))
    if hits is None:
        d = d.withColumn("ts", F.array().cast("array<string>"))
    else:
        size = hits.agg(F.count("*").alias("n"), F.sum(F.aggregate("ts", F.lit(0).cast("long"), lambda a, t: a + 24 + F.octet_length(t))).alias("b")).first()
        small = size.n <= MOST_TERMS and (size.b or 0) <= MOST_BYTES
        b = (F.broadcast(hits) if small else hits).select(F.col("doc_id").alias("_i"), F.col("h").alias("_h"), "ts")
        d = d.join(b, F.col("doc_id").eqNullSafe(F.col("_i")) & (F.col("h") == F.col("_h")), "left").drop("_i", "_h")
    d = _all_found(d)
    # terms are letters and digits: an alternation of them needs no quoting
    some = F.size(F.coalesce("ts", F.array().cast("array<string>"))) > 0
    p = F.when(some, F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), F.array_join("ts", "|"), F.lit(r")(?![\p{L}\p{N}])"))).otherwise(F.lit("(?!)"))
    d = _found(d.withColumn("_p", p), "term", F.when(some, F.col("text")).otherwise(""), F.col("_p")).drop("_p", "ts")
    # a term inside an entity is the entity's
    whole = F.concat(*KINDS)
    return d.withColumn("term", F.filter("term", lambda x: ~F.exists(whole, lambda y: (x["s"] < y["e"]) & (y["s"] < x["e"]))))


def find(docs: DataFrame, alpha: float = ALPHA, support: float = 0.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, h, and email, ip, card, phone, term: arrays of (s, e, v) for each row."""
    return _with_spans(docs, [], alpha, support, id_col, text_col).select("doc_id", "h", *KINDS, "term")


def _told(kind: str) -> Column:
    return F.transform(kind, lambda x: F.concat(F.lit(kind + ":"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string")))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term of find()'s rows."""
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(F.concat(*map(_told, KINDS)), ","), 256).alias("base_sha256"),
        F.array_join(F.concat(*map(_told, (*KINDS, "term"))), ",").alias("spans"),
        F.size("term").cast("long").alias("n_term"),
    )


def _as(name: str):
    return lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(name).alias("r"))


def sanitise(docs: DataFrame, alpha: float = ALPHA, support: float = 0.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with text_col rewritten: entities become [EMAIL], [IP], [CARD], [PHONE], disclosing terms [TERM]. Null stays null.

    A text is cut into blocks of BLOCK code points in one pass, so that a span's neighbourhood is found inside its block.
    """
    cols = docs.columns
    d = _with_spans(docs, [F.struct(*[F.col(c) for c in cols]).alias("row")], alpha, support, id_col, text_col)
    d = d.withColumn("_s", F.array_sort(F.concat(*[F.transform(k, _as(f"[{k.upper()}]")) for k in (*KINDS, "term")])))
    some = F.size("_s") > 0
    d = d.withColumn("_e", F.transform("_s", lambda x: x["e"]))
    # where all earlier spans end: of earlier groups of CHUNK, then inside the group
    top = lambda k: F.array_max(F.slice("_e", k * CHUNK + 1, CHUNK))
    groups = F.when(some, F.sequence(F.lit(0), F.floor((F.size("_s") - 1) / CHUNK).cast("int"))).otherwise(F.array().cast("array<int>"))
    d = d.withColumn("_m", F.aggregate(groups, F.array(F.lit(0).cast("long")), lambda acc, k: F.array_append(acc, F.greatest(F.element_at(acc, -1), top(k)))))

    def placed(x: Column, i: Column) -> Column:
        g = F.floor(i / CHUNK).cast("int")
        p = F.greatest(F.get("_m", g), F.coalesce(F.array_max(F.slice("_e", g * CHUNK + 1, i - g * CHUNK)), F.lit(0).cast("long")))
        return F.struct(p.alias("p"), x["s"].alias("s"), x["e"].alias("e"), x["r"].alias("r"))

    # a span that begins inside earlier ones adds nothing but its rest
    d = d.withColumn("_w", F.filter(F.transform("_s", placed), lambda x: x["e"] > x["p"]))
    d = d.withColumn("_b", F.when(some, F.regexp_extract_all("text", F.lit("(?s).{1,%d}" % BLOCK), F.lit(0))).otherwise(F.array().cast("array<string>")))

    def block(t: Column, i: Column) -> Column:
        lo = (i * BLOCK).cast("long")
        hi = lo + BLOCK
        mine = F.filter("_w", lambda x: (x["s"] < hi) & (x["e"] > lo))
        # what stands before each span of the block, then what stands for it if it begins here; then the rest
        cut = lambda a, b: F.substring(t, (a - lo + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))
        parts = F.transform(mine, lambda x: F.concat(cut(F.greatest(x["p"], lo), x["s"]), F.when((x["s"] >= lo) & (x["s"] >= x["p"]), x["r"]).otherwise("")))
        rest = F.least(F.array_max(F.transform(mine, lambda x: x["e"])), hi)
        return F.when(F.size(mine) > 0, F.concat(F.array_join(parts, ""), cut(rest, hi))).otherwise(t)

    new = F.when(F.col("row")[text_col].isNull(), F.lit(None)).when(some, F.array_join(F.transform("_b", block), "")).otherwise(F.col("text"))
    return d.withColumn("_n", new).select(*[F.col("_n").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in cols])
