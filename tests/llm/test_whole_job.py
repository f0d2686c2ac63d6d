"""What an operator must not leave out: parts of texts, pages, tokens and entities that a shorter way would not look at."""

import base64
import itertools
import math
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from quillspark.llm import chunks, compression, crf, disclosure, minhash, styletree


def _prose(n):
    rng = random.Random(4)
    syllables = [a + b + c for a in "bcdfghlmnprst" for b in "aeiou" for c in ("", "n", "r", "st", "l")]
    vocab = ["".join(rng.choice(syllables) for _ in range(rng.choice([1, 2, 2, 3]))) for _ in range(900)] + ["the", "of", "and", "to", "in"] * 60
    return " ".join(rng.choice(vocab) for _ in range(n))[:n]


def _base64(n):
    rng = random.Random(5)
    return base64.b64encode(bytes(rng.randrange(256) for _ in range(n))).decode()[:n]


def _kept(t):
    return compression.verdict(len(t), *compression.ratios(t.encode()))


# 1
def test_long_prose_with_noise_or_repetition_is_not_kept():
    prose = _prose(40_000)
    assert _kept(prose)
    assert not _kept(prose[:20_000] + _base64(20_000))
    # a fifth of the text
    assert not _kept(prose[:32_000] + _base64(8_000))
    assert not _kept(prose[:32_000] + "buy this now and save " * 370)


def test_every_byte_of_a_long_text_is_in_a_chunk():
    prose, noise = _prose(8_000), _base64(2048)
    assert [len(compression.ratios(prose[:n].encode())[1]) for n in (2047, 2048, 2049, 4095, 4096, 5000)] == [0, 1, 2, 2, 2, 3]
    # a chunk in a text of less than two, and the tail
    assert not _kept(noise + prose[:1900]) and not _kept(prose[:1900] + noise)
    assert not _kept(prose[: 2 * 2048] + noise[:2000])
    assert all(_kept(prose[:n]) for n in (2048, 3000, 4095, 5000, 8000))


# 2
def test_terms_of_rare_entities_and_far_from_them_disclose(spark):
    filler = " ".join(f"common{k}" for k in range(60))
    rows = [(k, f"{filler} plain{k % 9}") for k in range(1200)]
    rows += [(2000, f"Quendolin wrote {filler} to kim@corp.example"), (2001, f"call +49 170 1234567 {filler} {filler} ref Tazmo77")]
    rows += [(2002, f"Murgat has {filler} 10.1.2.3"), (2003, f"10.1.2.3 {filler} ask Murgat"), (2004, f"{filler} where is Quendolin")]
    out = {r.doc_id: r.text for r in disclosure.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "Quendolin" not in out[2000] + out[2004] and "Tazmo77" not in out[2001] and "Murgat" not in out[2002] + out[2003]
    assert filler in out[2000] and filler in out[2004] and all(out[i] == t for i, t in rows if i < 2000)
    # the entity's own words are no terms of it
    again = rows + [(2005, f"{filler} kim")]
    got = {r.doc_id: r.text for r in disclosure.sanitise(spark.createDataFrame(again, "doc_id long, text string")).collect()}
    assert got[2005] == again[-1][1]


# 9
def test_marginals_like_enumeration():
    rng = np.random.default_rng(2)
    trans = rng.normal(size=(2, 2))
    sizes = [1, 2, 5, 9, 8]
    x, seq = rng.normal(size=sum(sizes)) * 2, np.repeat(np.arange(len(sizes)), sizes)
    want = []
    for k, n in enumerate(sizes):
        e, total, on = x[seq == k], 0.0, np.zeros(n)
        for tags in itertools.product((0, 1), repeat=n):
            w = math.exp(sum(v for v, t in zip(e, tags, strict=True) if t) + sum(trans[a, b] for a, b in itertools.pairwise(tags)))
            total += w
            on += w * np.array(tags)
        want.append(on / total)
    assert np.abs(crf.marginals(x, seq, trans) - np.concatenate(want)).max() < 1e-12


# 5
def test_style_tree_decides_inside_articles(spark):
    body = "<html><body><div class=top>Top line of the site</div><article><h2>Story {0}</h2><div class=x><p>Read this with our app</p></div><p>{1}</p></article></body></html>"
    same = "<html><body><article><p>All there is on this host</p></article></body></html>"
    own = [f"Text number {k} is of its own kind and goes on for {k * 3} words" for k in range(20)]
    pages = [(k, f"https://site.example/{k}", body.format(k, own[k])) for k in range(20)] + [(100 + k, f"https://same.example/{k}", same) for k in range(20)]
    got = {r.page_id: r.text for r in styletree.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    want = {k: f"Story {k} {own[k]}" for k in range(20)}
    # a page is never left empty
    assert got == want | {100 + k: "All there is on this host" for k in range(20)}


# 2
def _brute_terms(texts, spans_of, alpha, z):
    """Spans of disclosing terms of each text, by the definition; spans_of: the entities' kind -> [(start, end)] of a text."""
    n = len(texts)
    docs_of, with_term, pair = defaultdict(set), defaultdict(set), Counter()
    terms_of = lambda t: {w for w in re.split(r"[^\w]|_", t.lower()) if len(w) >= 2}
    for k, t in enumerate(texts):
        for w in terms_of(t):
            with_term[w].add(k)
        found, out, at = set(), [], 0
        for kind, spans in spans_of(t).items():
            for a, b in spans:
                found.add(f"{kind}:" + (t[a:b].lower() if kind in ("email", "ip") else re.sub("[^0-9]", "", t[a:b])))
        for a, b in sorted(x for v in spans_of(t).values() for x in v):
            out.append(t[at : max(a, at)])
            at = max(at, b)
        out.append(t[at:])
        for e in found:
            docs_of[e].add(k)
            for w in terms_of("\n".join(out)):
                pair[e, w] += 1
    told = set()
    for (e, w), k in pair.items():
        if len(docs_of[e]) < n:
            ic, df = -math.log(len(docs_of[e]) / n), len(with_term[w])
            p = k / df
            low = (p + z * z / (2 * df) - z * math.sqrt(p * (1 - p) / df + z * z / (4 * df * df))) / (1 + z * z / df)
            if math.log(max(low, 1e-300)) + ic >= alpha * ic:
                told.add(w)
    out = []
    for t in texts:
        whole = [x for v in spans_of(t).values() for x in v]
        runs = [(m.start(), m.end()) for m in re.finditer(r"[^\W_]+", t) if m[0].lower() in told]
        out.append([x for x in runs if not any(x[0] < b and a < x[1] for a, b in whole)])
    return out


@pytest.mark.parametrize("support", [0.0, 1.0])
def test_terms_like_brute_force(spark, small_dir, support):
    from test_operators import _spans

    rows = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text").collect())
    # entities of several documents, and enough documents that one suffices
    rows += [(10_000 + k, f"filler words number{k % 40} of row{k}" + (f" ask Zorba{k % 3} a@b.example" if k < 6 else "")) for k in range(1500)]
    want = _brute_terms([t for _, t in rows], _spans, disclosure.ALPHA, support)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: [(x.s, x.e) for x in r.term] for r in disclosure.find(docs, support=support).select("doc_id", "term").collect()}
    assert got == {i: w for (i, _), w in zip(rows, want, strict=True)}
    assert any(want)
    names = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}
    new = {r.doc_id: r.text for r in disclosure.sanitise(docs, support=support).collect()}
    for (i, t), w in zip(rows, want, strict=True):
        out, at = [], 0
        for a, b, r in sorted([(a, b, names[k]) for k, v in _spans(t).items() for a, b in v] + [(a, b, "[TERM]") for a, b in w]):
            if a >= at:
                out += [t[at:a], r]
            at = max(at, b)
        assert new[i] == "".join(out) + t[at:]


def test_many_and_overlapping_spans_of_a_text(spark):
    texts = ["me@x.io 10.0.0.1 " * 700 + "end", "1.1.1." * 600 + "1@b.co tail", "x" * 1020 + " a.b@c.de " + "y" * 1020 + " +49 170 1234567", "\U0001f600 me@x.io " * 400]
    out = {r.doc_id: r.text for r in disclosure.sanitise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), support=1.0).collect()}
    # of two spans that begin together the shorter comes first, and the longer one's rest goes with it
    assert out == {0: "[EMAIL] [IP] " * 700 + "end", 1: "[IP] tail", 2: "x" * 1020 + " [EMAIL] " + "y" * 1020 + " [PHONE]", 3: "\U0001f600 [EMAIL] " * 400}


# 5
def test_unclosed_elements_and_deep_nesting_keep_the_text():
    shown = lambda page: [b.text for b in styletree.parse(page)[0] if not b.never]
    for tag in ("select", "svg", "object", "iframe", "noscript", "template"):
        assert shown(f"<p>one</p><{tag} a=b><p>two</p><p>three</p>") == ["one", "two", "three"]
        assert shown(f"<p>one</p><{tag}><p>gone</p></{tag}><p>three</p>") == ["one", "three"]
    assert shown("<p>one</p><script>x<p>gone</p>") == ["one"]
    start = time.process_time()
    assert len(shown("<div>x" * 40_000)) == 40_000
    assert len(shown("<p>y<select>" * 20_000)) == 20_000
    assert time.process_time() - start < 20
    # what surrounds a block marks it, however deep it is
    deep = styletree.parse("<nav><div><b><div>menu</div></b></div></nav><article><div><header><h1>head</h1></header><i>text</i></div></article>")[0]
    assert [(b.text, b.never, b.main) for b in deep] == [("menu", True, False), ("head", False, True), ("text", False, True)]


# 8
def test_a_family_below_the_threshold_is_not_paired(spark, monkeypatch):
    """Texts of one template, similarity about 0.8, without links: the rows of pairs stay in proportion to the texts."""
    rng = random.Random(9)
    n, words = 1200, 200
    base = [f"t{k}" for k in range(words)]
    rows = []
    for k in range(n):
        t = list(base)
        for at in range(10, words, words // 4):
            t[at] = f"u{k}x{at}"
        rows.append((k, " ".join(t)))
    # some links in the family and beside it
    rows += [(n + k, rows[k][1] + " end") for k in range(0, 40, 4)] + [(2 * n, "alone " * 3), (2 * n + 1, " ".join(rng.choice(base) for _ in range(90)))]
    made = []
    confirm = minhash._confirm

    def counted(pairs, sets, percent):
        made.append(pairs.count())
        return confirm(pairs, sets, percent)

    monkeypatch.setattr(minhash, "_confirm", counted)
    got = {r.doc_id: r.component_id for r in minhash.classes(spark.createDataFrame(rows, "doc_id long, text string"), percent=85).collect()}
    linked = {n + k: k for k in range(0, 40, 4)}
    assert got == {i: linked.get(i, i) for i, _ in rows}
    assert sum(made) < 100 * n


def _sets(spark, sets, comps):
    """left and sets, as the last turn gets them."""
    left = [(bytes([k // 256, k % 256]), len(s), minhash.odd_sketch([np.array(sorted(s), np.uint64)])[0].tolist(), bytes([c // 256, c % 256])) for k, (s, c) in enumerate(zip(sets, comps, strict=True))]
    items = [(r[0], sorted(s)) for r, s in zip(left, sets, strict=True)]
    return spark.createDataFrame(left, "node binary, n long, odd array<long>, comp binary"), spark.createDataFrame(items, "node binary, items array<long>")


@pytest.mark.parametrize("percent", [60, 80, 85, 100])
def test_last_turn_meets_every_similar_pair_once_or_twice(spark, percent):
    rng = random.Random(percent)
    sets, comps = [], []
    for g in range(12):
        base = [rng.randrange(1, 1 << 40) for _ in range(rng.choice([1, 2, 9, 40, 150]))]
        for _ in range(rng.choice([2, 15, 30])):
            s = set(base[rng.choice([0, 0, len(base) // 9]) :])
            for _ in range(rng.choice([0, 1, 2, len(base) // 12, len(base) // 8])):
                s.discard(rng.choice(base))
                s.add(rng.choice([rng.randrange(1, 1 << 40), g + 1, g + 2]))
            if s and s not in sets:
                sets.append(s)
                comps.append(len(sets) if rng.random() < 0.9 else 0)
    left, items = _sets(spark, sets, comps)
    at = lambda b: b[0] * 256 + b[1]
    rows = [tuple(sorted((at(r.node), at(r.a)))) for r in minhash._meet(minhash._rare(left, items, percent), percent).collect()]
    want = {(i, k) for k in range(len(sets)) for i in range(k) if comps[i] != comps[k] and 100 * len(sets[i] & sets[k]) >= percent * len(sets[i] | sets[k])}
    assert want <= set(rows) and (want or percent == 100)
    assert all(comps[i] != comps[k] for i, k in rows)
    assert len(rows) <= 2 * len(set(rows))


def test_a_family_that_shares_rare_items_makes_few_rows(spark):
    """Texts of one template that differ at the same places, similarity 0.844, without links: no join makes a row a pair."""
    n, words = 300, 300
    rows = []
    for k in range(n):
        t = [f"t{w}" for w in range(words)]
        for at in (30, 80, 130, 180, 230):
            t[at] = f"u{k}x{at}"
        rows.append((k, " ".join(t)))
    store = spark._jsparkSession.sharedState().statusStore()
    ran = store.executionsCount()
    got = minhash.classes(spark.createDataFrame(rows, "doc_id long, text string"), percent=85).collect()
    assert all(r.kept and r.component_id == r.doc_id for r in got)
    made = []
    runs = store.executionsList()
    for x in (runs.apply(k) for k in range(ran, runs.size())):
        values, nodes = store.executionMetrics(x.executionId()), store.planGraph(x.executionId()).allNodes()
        for node in (nodes.apply(k) for k in range(nodes.size())):
            metrics = node.metrics()
            for m in (metrics.apply(k) for k in range(metrics.size())):
                if "Join" in node.name() and m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    made.append(int(values.apply(m.accumulatorId()).replace(",", "")))
    # tables of the nodes are joined too, M * (M - 1) / 2 of each at most
    assert made and max(made) < n * minhash.M * (minhash.M - 1) // 2


def test_a_chunk_is_looked_up_once_a_batch():
    class Counted(dict):
        asked = 0

        def get(self, key, default=None):
            self.asked += 1
            return super().get(key, default)

    def encode(strings):
        raw = [x.encode() for x in strings]
        return np.frombuffer(b"".join(raw), np.uint8).astype(np.int32), np.array([len(x) for x in raw], np.int64)

    cache = chunks.ChunkCache(encode, public_tokenizers.PATTERN)
    cache.spaced = Counted()
    texts = [None, "", " ", "   ", "one", " one", "x\n y\u3000 \u3000z  ", "\t a\u2003", "é, \x85 é.\n\n É", "🙂 🙂", *["the end, of the end. " * 500] * 4]
    for _ in range(2):
        before = cache.spaced.asked
        flat, per = cache.batch(texts)
        assert bytes(flat.tolist()).decode() == "".join(t or "" for t in texts)
        assert per.tolist() == [len((t or "").encode()) for t in texts]
        assert cache.spaced.asked - before <= len({w for t in texts for w in (t or "").split(" ")})


def test_words_are_kept_and_not_their_forms():
    asked = []

    def encode(strings):
        asked.extend(strings)
        raw = [x.encode() for x in strings]
        return np.frombuffer(b"".join(raw), np.uint8).astype(np.int32), np.array([len(x) for x in raw], np.int64)

    cache = chunks.ChunkCache(encode, public_tokenizers.PATTERN)
    words, signs = ["ab", "cd", "é"], [".", ",", ".)", "###"]
    forms = [w + s for w in words for s in signs]
    texts = ["start " + " ".join(a + "\n" + b for a in forms for b in forms), "start " + " ".join(forms), "start ab\n\ncd ab\n\u3000cd ab.\n"]
    for _ in range(2):
        flat, per = cache.batch(texts)
        assert bytes(flat.tolist()).decode() == "".join(texts)
        assert per.tolist() == [len(t.encode()) for t in texts]
    # words with a space before them and without, signs, a line's end, the first word; and the three that are not taken apart
    assert len(asked) == len(set(asked)) == cache.n <= 2 * len(words) + len(signs) + 2 + 3


def test_letters_like_the_library():
    from tokenizers import Tokenizer

    from quillspark.llm import simple8b

    path = public_tokenizers.path("byte_bpe_50k.json")
    letters = [chr(k) for k in range(0x300) if chr(k).isalpha()]
    texts = ["a " + " ".join("x" * (k % 3) + c + "yz"[: k % 2] for k, c in enumerate(letters)), "\n".join(letters), "don't we're, it's.\nI'll \u01f0\u0237 \u0920"]
    flat, per = simple8b._encoder(path, public_tokenizers.PATTERN)(texts)
    want = [Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids for t in texts]
    assert per.tolist() == [len(x) for x in want] and flat.tolist() == [i for x in want for i in x]


def test_runs_are_packed_like_a_plain_walk():
    from quillspark.llm import simple8b

    r = np.random.default_rng(4)
    for k in range(40):
        ids = r.integers(0, [1, 2, 9, 300, 60_000, 1 << 50][k % 6], int(r.integers(1, 700))).astype(np.uint64)
        ids[r.random(len(ids)) < k % 3 * 0.45] = 0
        _, size = simple8b._blocks(np.array([len(ids)]))
        words, per = simple8b.pack(ids, size)
        want = []
        for lo in range(0, len(ids), simple8b.BLOCK):
            block, at = ids[lo : lo + simple8b.BLOCK].tolist(), 0
            while at < len(block):
                s = next(s for s in range(16) if all(x >> int(simple8b.BITS[s]) == 0 for x in block[at : at + int(simple8b.COUNT[s])]))
                want.append(s)
                at += int(simple8b.COUNT[s])
        assert (words >> np.uint64(60)).tolist() == want and len(words) == per.sum()
        assert (simple8b.unpack(words, per, size) == ids).all()


def test_a_worker_drops_what_other_operators_kept(spark):
    import pyarrow as pa

    from quillspark.llm import bpe, common

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")

    class Docs:
        """Gives what would run in a worker."""

        sparkSession, schema, columns = spark, spark.createDataFrame([], "doc_id long, text string").schema, ["doc_id", "text"]

        def mapInArrow(self, run, _):
            return run

    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["one two three four five six"])], ["doc_id", "text"])
    bpe._cache(path, public_tokenizers.PATTERN).batch(["a word"])
    kept = bpe._cache(path, public_tokenizers.PATTERN)
    list(common.given_back(iter, bpe._cache, bpe._model)([batch]))
    assert bpe._cache(path, public_tokenizers.PATTERN) is kept
    for run in (minhash.nodes(Docs(), 5), minhash.full_sets(Docs(), 5)):
        bpe._cache(path, public_tokenizers.PATTERN)
        assert [b.num_rows for b in run(iter([batch]))] == [1]
        assert bpe._cache.cache_info().currsize == bpe._model.cache_info().currsize == 0


def test_white_space_at_the_ends_of_chunks():
    odd = ["", "a", "\u3000", "\ta", "a\x85", "\u2003ab\n", "🙂", "\u3001", "", "é\xa0"]
    opens, closes = chunks._white_ends(odd)
    assert opens.tolist() == [not x or x[0] in chunks.WHITE for x in odd]
    assert closes.tolist() == [not x or x[-1] in chunks.WHITE for x in odd]
    assert [len(x) for x in chunks._white_ends([])] == [0, 0]
