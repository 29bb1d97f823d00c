"""Each corpus query that has no SQL against a plain version of its own, over whole tables."""

import os
import random
import struct
import time
import zlib
from collections import Counter
from hashlib import md5, sha256
from html.parser import HTMLParser
from math import log2, sqrt

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import html_text, jaccard, langid, mixing, pieces, quality_cnn, queries, rules, sharding, telephony

DATA = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}


@needs_data
@pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="no vocabulary")
def test_pieces_of_all_documents_equal_the_library(spark, texts):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rows = queries.op1_sentencepiece(spark, DATA).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = model.encode(texts[r.doc_id] or "")
        assert (r.ids or []) == want and r.n_tokens == len(want) and r.ids_sha256 == sha256(struct.pack(f"<{len(want)}i", *want)).hexdigest()
        assert r.decoded_sha256 == sha256(model.decode(want).encode()).hexdigest() and r.round_trip


@pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="no vocabulary")
def test_pieces_by_a_vocabulary_sent_with_the_job(spark):
    name = pieces.ship(spark, pieces.MODEL)
    df = spark.createDataFrame([(1, "a word")], "doc_id long, text string")
    assert not os.path.isabs(name)
    assert pieces.encode_texts(df, ["doc_id"], name).first().ids == pieces.encode_texts(df, ["doc_id"]).first().ids


@needs_data
def test_sharding_of_all_documents(spark, texts):
    size, names = sharding.TABLE_SIZE, sorted(sharding.SHARDS)
    step = {n: sharding._number(n, "skip") % (size - 1) + 1 for n in names}
    at = {n: sharding._number(n, "offset") % size for n in names}
    owner = {}
    turn = 0
    while len(owner) < size:  # shards take turns, each claims the first free slot of its own order
        n = names[turn % len(names)]
        while at[n] in owner:
            at[n] = (at[n] + step[n]) % size
        owner[at[n]] = n
        turn += 1
    rows = queries.op3_sharding(spark, DATA).collect()
    assert len(rows) == len(texts)
    for r in rows:
        slot = int(md5(str(r.doc_id).encode()).hexdigest()[:15], 16) % size
        assert (r.slot, r.shard) == (slot, owner[slot])


def test_sharding_edges(spark):
    rows = [(None, "x", 5, "old"), (None, "x", 5, "old"), (7, None, None, None), (7, "y", 1, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, slot int, shard string")
    got = sharding.assign(df, shards=["a", "b", "c"], size=101).collect()
    assert len(got) == 4 and len({(r.slot, r.shard) for r in got if r.doc_id is None}) == 1 == len({r.shard for r in got if r.doc_id == 7}) and {r.shard for r in got} <= {"a", "b", "c"}
    assert sharding.assign(df.limit(0)).count() == 0 and got[0].__fields__ == ["doc_id", "text", "slot", "shard"]


@needs_data
def test_languages_by_plain_compression(spark, texts):
    import zstandard as z

    dictionaries = langid.fit(spark.read.parquet(f"{DATA}/documents.parquet"))
    p = z.ZstdCompressionParameters(window_log=18, hash_log=15, chain_log=15, search_log=2, min_match=3, target_length=32, strategy=z.STRATEGY_LAZY, write_content_size=False, write_checksum=False, write_dict_id=False)
    coders = {n: z.ZstdCompressor(compression_params=p, dict_data=z.ZstdCompressionDict(d, dict_type=z.DICT_TYPE_RAWCONTENT)) for n, d in dictionaries.items()}
    wrong = seen = 0
    for r in queries.op4_language_id(spark, DATA).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        text = texts[r.doc_id] or ""
        if not any(c.isalpha() for c in text):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
            continue
        plain = " ".join("".join(c if c.isalpha() and c.isascii() or not c.isascii() else " " for c in text.lower()).split(" ")).encode()
        plain = b" ".join(plain.split())
        sizes = {n: sum(len(c.compress(b" " * 64 + plain[i : i + 16_384])) for i in range(0, len(plain), 16_384) or [0]) for n, c in coders.items()}
        best = min(sizes.values())
        others = sorted(sizes.values())[1]
        seen += 1
        # a dictionary prepared beforehand may find other matches than one that is loaded each time
        wrong += sizes[r.lang_pred] > best * 1.02 or (others - best) / others > 0.02 and r.rejected
    assert seen > 900 and wrong == 0


def test_languages_copies_many_and_edges(spark):
    import random

    r = random.Random(4)
    word = lambda letters: "".join(r.choice(letters) for _ in range(r.randint(3, 8)))
    some = lambda letters, n: [" ".join(word(letters) for _ in range(60)) for _ in range(n)]
    copies = some("etaoin", 1) * 5000
    rows = [(t, "en") for t in copies + some("etaoin", 40)] + [(t, "de") for t in some("ßüxkzw", 60)]
    df = spark.createDataFrame([(i, t, n) for i, (t, n) in enumerate(rows)], "doc_id long, text string, lang string")
    fitted = langid.fit(df)
    assert list(fitted) == ["de", "en"] and len(fitted["en"]) > 3000  # copies take no other text's place
    many = spark.createDataFrame([(i, f"w{i % 90} x{i}y some text", f"l{i % 90}") for i in range(900)], "doc_id long, text string, lang string")
    found = langid.fit(many)
    assert len(found) == 90 and all(found.values())
    odd = spark.createDataFrame([(1, None, "a", 1.0), (2, "", "b", 2.0), (3, "12 3", "c", 3.0), (4, (copies[0] + " ") * 300, "d", 4.0), (4, None, None, None)], "doc_id long, text string, LANG_PRED string, score double")
    got = langid.identify(odd, fitted, odd.columns).collect()
    assert got[0].__fields__ == ["doc_id", "text", "lang_pred", "score", "rejected"] and [x.lang_pred for x in got] == ["und", "und", "und", "en", "und"]
    assert langid.identify(odd.limit(0), fitted, ["doc_id"]).count() == 0 and langid.identify(odd, {}, ["doc_id"]).where("lang_pred <> 'und'").count() == 0
    # a tie names the first dictionary, and its margin rejects
    twins = langid.identify(odd.where("doc_id = 4 and text is not null"), {"x": fitted["en"], "y": fitted["en"]}, ["doc_id"]).first()
    assert twins.lang_pred == "x" and twins.rejected


def _slow_score(net, data: bytes) -> float:
    """The network by loops over single windows."""
    halves = max(1, -(-len(data) // quality_cnn.HALF))
    size = halves * quality_cnn.HALF
    at = lambda i: data[i] if 0 <= i < len(data) else 0

    def echo(block):
        own = [at(8 * block + j) for j in range(8)]
        return float(all(own) and any(all(at(8 * block + j - lag) == own[j] for j in range(8)) for lag in quality_cnn.LAGS))

    echoes = [echo(b) for b in range(size // 8 + 2)]
    top = np.full((halves, quality_cnn.FILTERS), -np.inf)
    for w in range(size // quality_cnn.STEP):
        z = np.zeros(quality_cnn.FILTERS)
        for k in range(quality_cnn.WIDTH // quality_cnn.STEP):
            first = (w + k) * quality_cnn.STEP
            x = np.concatenate([net.embed[at(first + j)] for j in range(quality_cnn.STEP)] + [[echoes[first // 8] if first < size else 0.0]])
            z += x @ net.filters[k]
        top[w * quality_cnn.STEP // quality_cnn.HALF] = np.maximum(top[w * quality_cnn.STEP // quality_cnn.HALF], z)
    chunks = [np.maximum(a, b) for a, b in zip(top, top[1:], strict=False)] or [top[0]]
    m = np.maximum(np.array(chunks) + net.bias, 0)
    return 1 / (1 + np.exp(-(m.mean(axis=0) @ net.mean + m.max(axis=0) @ net.peak + net.shift[0])))


def test_quality_by_loops_and_gradient():
    net = quality_cnn.start(3)
    r = random.Random(6)
    for text in (b"", b"a", b"one two three " * 3, bytes(r.randrange(256) for _ in range(255)), bytes(r.randrange(97, 123) for _ in range(700)), b"abcab" * 120 + b"rest of it"):
        x = np.frombuffer(text, np.uint8)
        assert abs(quality_cnn.score(net, x) - _slow_score(net, text)) < 1e-4
    pair = b"first text " * 40 + b"second " * 90
    both = quality_cnn.score_many(net, np.frombuffer(pair, np.uint8), np.array([0, 440, 440, len(pair)]))
    assert np.allclose(both, [quality_cnn.score(net, np.frombuffer(t, np.uint8)) for t in (pair[:440], b"", pair[440:])], atol=1e-4)
    # the gradient against differences of the loss
    x = quality_cnn._padded(np.frombuffer(b"some words of a text, and more " * 20, np.uint8))
    grads, _ = quality_cnn._gradient(net, x, quality_cnn._echo(x), 1.0)
    loss = lambda n: quality_cnn._gradient(n, x, quality_cnn._echo(x), 1.0)[1]
    params = [net.embed, net.filters, net.bias, net.mean, net.peak, net.shift]
    for p, g in zip(params, grads, strict=True):
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        old, h = p[at], np.float32(2e-3)
        p[at] = old + h
        up = loss(net)
        p[at] = old - h
        down = loss(net)
        p[at] = old
        assert abs((up - down) / (2 * float(h)) - g[at]) < 0.05 * abs(g[at]) + 5e-3


def test_quality_edges(spark):
    net = quality_cnn.start(1)
    rows = [(1, None, 9.0), (2, "", 9.0), (3, "same text", 9.0), (3, "same text", 9.0), (4, "same text", 9.0), (5, "x" * 300_000, 9.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, Score double").repartition(3)
    got = quality_cnn.score_texts(df, net, ["doc_id", "Score"]).collect()
    by = {r.doc_id: r.score for r in got}
    assert got[0].__fields__ == ["doc_id", "score"] and len(got) == 6 and by[1] == by[2] and by[3] == by[4]
    assert quality_cnn.score_texts(df.limit(0), net, ["doc_id"]).count() == 0
    # long texts are trained on as well, by a window anywhere in them
    docs = spark.createDataFrame([(k, ("start " if k % 2 else "begin ") * 4000 + f"end{k}") for k in range(40)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).alias("quality"))
    found, marks = quality_cnn.sample(docs, labels)
    assert len(found) == len(marks) > 20 and all(len(t) == quality_cnn.SAMPLE_CHARS for t in found)


class _Lines(HTMLParser):
    """Blocks by the library's parser, for pages whose elements are closed."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines, self.stack, self.parts, self.linked = [], [], [], 0
        self.marks = self.link = 0

    def flush(self):
        text = " ".join("".join(self.parts).split())
        if text:
            part = next((k for _, k in self.stack if k), 0)
            self.lines.append((text, self.linked / max(1, sum(map(len, self.parts))), part, self.marks if any(n in ("article", "main") for n, _ in self.stack) else 0))
        self.parts, self.linked = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in html_text.BLOCK:
            self.flush()
            if self.stack and self.stack[-1][0] == "p":
                self.stack.pop()
        if tag == "br":
            self.parts.append(" ")
        if tag in html_text.VOID:
            return
        marked = any(n in ("article", "main") for n, _ in self.stack)
        part = html_text.EDGE if tag in html_text.EDGES and not (tag == "header" and marked) else html_text.CUT if tag in html_text.INSERTS else 0
        words = " ".join(v or "" for k, v in attrs if k in ("class", "id", "role"))
        if not part and tag not in ("html", "body", "a", "article", "main"):
            part = html_text.EDGE if html_text._EDGE_NAMES.search(words) else html_text.CUT if html_text._INSERT_NAMES.search(words) else 0
        if part:
            self.flush()
        if tag in ("article", "main") and not marked:
            self.marks += 1
        self.stack.append((tag, part))
        self.link = tag == "a" or self.link

    def handle_endtag(self, tag):
        if tag in html_text.BLOCK:
            self.flush()
        if tag == "a":
            self.link = 0
        if any(n == tag for n, _ in self.stack):
            while self.stack.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if not any(n in html_text.RAW for n, _ in self.stack):
            self.parts.append(data)
            self.linked += len(data) if self.link else 0


def _plain_text(page: str) -> str:
    reader = _Lines()
    reader.feed(page)
    reader.close()
    reader.flush()
    lines = [x for x in reader.lines if x[2] != html_text.CUT]

    def stretches(sizes):
        out = []
        for k, n in enumerate(sizes):
            if n and (k == 0 or not sizes[k - 1]):
                out.append([])
            if n:
                out[-1].append(k)
        return out

    plain = [0 if part or link > 0.5 else len(t) for t, link, part, _ in lines]
    held = Counter()
    for t, _, part, mark in lines:
        held[mark] += 0 if part or not mark else len(t)
    outside = [0 if x[3] else n for x, n in zip(lines, plain, strict=True)]
    if any(held.values()) and max(held.values()) >= max([sum(outside[k] for k in s) for s in stretches(outside)] or [0]):
        lines = [x for x in lines if not (x[2] and x[3])]
        plain = [4 * len(x[0]) if x[3] else 0 for x in lines]
    spans = stretches(plain)
    window = lambda s, i: sum(plain[k] for k in s[i : i + 3])
    largest = max([window(s, i) for s in spans for i in range(len(s))] or [0])
    out = []
    for s in spans:
        if any(window(s, i) >= min(80, largest / 4) for i in range(len(s))):
            out += [lines[k][0] for k in s]
    return "\n".join(out)


@needs_data
def test_html_of_all_pages_equals_plain_windows(spark):
    pages = {r.page_id: (r.url, r.html) for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    rows = queries.op6_html_text(spark, DATA).collect()
    assert len(rows) == len(pages)
    for r in rows:
        url, page = pages[r.page_id]
        assert (r.url, r.text, r.n_chars) == (url, _plain_text(page or ""), len(r.text))


def test_html_parts_of_pages():
    page = lambda inner: html_text.main_text("<article><p>" + "word " * 40 + inner + "</article><p>after").split("\n")[1:]
    gone = ["<section id=comments><article>c1</article><article>c2</article></section>", '<ol class="commentlist"><li>c1<li>c2</ol>', "<div class=cookiebar>x</div>", "<aside>x</aside>", "<div hidden>x</div>", "<form>x</form>", "<script>x</script>"]
    assert all(page(x) == [] for x in gone)
    kept = ['<p class="side">KEEP', '<div class="tags">KEEP</div>', '<div class="social history">KEEP</div>', "<div class=ad>Buy<p>KEEP", "<p class=advert>buy<p>KEEP", "<div class=commentary>KEEP</div>", "<aside>no</aside><p>KEEP", "<header>KEEP</header>"]
    assert all(page(x) == ["KEEP"] for x in kept)
    # the last word of a name says what a part is, words for its place left out
    assert page('<div class="search-results">KEEP</div><p class="alert-level">two') == ["KEEP", "two"]
    assert all(page(f'<div class="{x}">x</div>') == [] for x in ("cookie-notice", "ad-box-2", "ad 300x250", "share_buttons", "sidebar left", "search-form", "newsletter-signup"))
    assert page("<p>one<br>two <math><mi>x</mi></math>") == ["one two x"]
    assert html_text.main_text("<body><p>" + "word " * 50 + "<div class=ad>x</div><p>Short end.</body>").split("\n")[1:] == ["Short end."]


def test_html_nesting_is_read_in_one_pass():
    began = time.monotonic()
    for page in ("<div>" * 40_000 + "x" + "</b>" * 40_000, "<aside>" + "<div>" * 20_000 + "</b>" * 20_000, "<p class=ad>" * 40_000 + "</div>" * 40_000):
        html_text.main_text(page)
    assert time.monotonic() - began < 6  # minutes, when every end looked through all open elements


def test_html_edges(spark):
    long = "<article>" + "".join(f"<p>{'word ' * 30}{k}" for k in range(3000)) + "</article>"
    df = spark.createDataFrame([(1, long, "t", 0), (2, None, "t", 0), (2, None, "t", 0), (3, "", "t", 0)], "page_id long, html string, Text string, n_chars int")
    got = html_text.extract(df, ["page_id", "Text", "n_chars"]).collect()
    assert got[0].__fields__ == ["page_id", "text", "n_chars"] and sorted(r.text.count("\n") for r in got) == [0, 0, 0, 2999]
    assert html_text.extract(df.limit(0), ["page_id"]).count() == 0


def _plain_pcm(name: str, payload: bytes) -> list[int]:
    if name != "ima_adpcm":
        table = telephony.MULAW_PCM if name == "mulaw" else telephony.ALAW_PCM
        return [int(table[b]) for b in payload]
    out = []
    for a in range(0, len(payload), 36):
        b = payload[a : a + 36]
        v, i = int.from_bytes(b[:2], "little", signed=True), min(b[2], 88)
        out.append(v)
        for n in (x for byte in b[4:] for x in (byte & 15, byte >> 4)):
            s = int(telephony._STEPS[i])
            d = (s >> 3) + (s if n & 4 else 0) + (s >> 1 if n & 2 else 0) + (s >> 2 if n & 1 else 0)
            v = max(-32768, min(32767, v - d if n & 8 else v + d))
            i = max(0, min(88, i + int(telephony._CHANGES[n])))
            out.append(v)
    return out


def _plain_resampled(pcm: list[int], up: int, down: int, taps: int = 8) -> list[int]:
    cut, out = min(1.0, up / down), []
    for m in range(-(-len(pcm) * up // down)):
        base, phase = divmod(m * down, up)
        total = 0
        for k in range(2 * taps):
            t = (k - taps + 1) - phase / up
            w = round(float(cut * np.sinc(cut * t) * (0.5 + 0.5 * np.cos(np.pi * max(-1, min(1, t / taps)))) * 16384))
            i = base + 1 + k - taps
            total += w * (pcm[i] if 0 <= i < len(pcm) else 0)
        out.append(max(-32768, min(32767, (total + 8192) >> 14)))
    return out


@needs_data
def test_telephony_of_all_documents(spark, texts):
    rows = queries.op7_telephony(spark, DATA).collect()
    assert len(rows) == len(texts) and {r.codec for r in rows} == {c for c, _ in telephony.CODECS}
    short = 0
    for r in rows:
        text = (texts[r.doc_id] or "").encode()
        payload = text + b"\xff" * (max(1, -(-len(text) // 576)) * 576 - len(text))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text), len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert r.pcm_bytes == 4 * (len(payload) // 36 * 65 if r.codec == "ima_adpcm" else len(payload))
        if len(payload) <= 576 and short < 60:
            short += 1
            wide = _plain_resampled(_plain_pcm(r.codec, payload), 2, 1)
            turns = sum((a < 0) != (b < 0) for a, b in zip(wide, wide[1:], strict=False))
            assert r.pcm_sha256 == sha256(struct.pack(f"<{len(wide)}h", *wide)).hexdigest()
            assert r.feature == f"n={len(wide)};mean={sum(map(abs, wide)) // len(wide)};peak={max(map(abs, wide))};turns={turns}"
    assert short > 20


def test_telephony_resampling_and_edges(spark):
    x = np.random.default_rng(1).integers(-32768, 32767, 300).astype(np.int16)
    for up, down in ((2, 1), (3, 2), (1, 2), (441, 80), (4, 6)):
        assert telephony.resample(x, up, down).tolist() == _plain_resampled(x.tolist(), up, down)
    long = np.random.default_rng(2).integers(-32768, 32767, 200_000).astype(np.int16)
    whole = telephony.Signal().take([telephony.resample(long, 2, 1)])
    parts = telephony.Signal().take(telephony.resampled(long, 2, 1))  # several stretches
    assert whole.feature == parts.feature and whole.digest.hexdigest() == parts.digest.hexdigest()
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "y" * 400_000, 5), (4, "same", 5), (5, "same", 5)], "doc_id long, text string, N_bytes int")
    got = {r.doc_id: r for r in telephony.store_texts(df, ["doc_id", "N_bytes"]).collect()}
    assert got[1].__fields__[:2] == ["doc_id", "n_bytes"] and got[1][1:] == got[2][1:] and got[4][1:] == got[5][1:] and got[3].payload_bytes == 400_320
    assert telephony.store_texts(df.limit(0), ["doc_id"]).count() == 0


@needs_data
def test_rules_by_plain_counts(spark, texts):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang").collect()
    kinds = [lambda c: "a" <= c <= "z", lambda c: "A" <= c <= "Z", lambda c: "0" <= c <= "9", lambda c: c in " \t\n\v\f\r", lambda c: c in ".,;:?'\"()-", lambda c: "!" <= c <= "~", lambda c: c < "\x80", lambda c: True]
    kind = {}

    def classes(text):
        out = [0] * 8
        for c, n in Counter(text).items():
            if c not in kind:
                kind[c] = next(k for k, f in enumerate(kinds) if f(c))
            out[kind[c]] += n
        return out

    lower = lambda t: "".join(c.lower() if c.isascii() else c for c in t)
    words = {i: [w for w in _split(t or "")] for i, t in texts.items()}
    by_lang, class_sums = {}, {}
    for r in rows:
        if r.lang is not None and texts[r.doc_id] is not None:
            by_lang.setdefault(r.lang, Counter()).update(lower(w) for w in words[r.doc_id])
            class_sums[r.lang] = [a + b for a, b in zip(class_sums.get(r.lang, [0] * 8), classes(texts[r.doc_id]), strict=True)]

    def js(p, q):
        part = lambda a: sum(x * log2(2 * x / (y + z)) for x, y, z in zip(a, p, q, strict=True) if x)
        return sqrt(max(0, (part(p) + part(q)) / 2))

    share = lambda x: [v / sum(x) for v in x]
    common = {n: sorted(c.items(), key=lambda x: (-x[1], x[0].encode()))[:64] for n, c in by_lang.items()}
    for r in queries.op8_quality_rules(spark, DATA).collect():
        text, own = texts[r.doc_id] or "", words[r.doc_id]
        lines = [x for x in text.split("\n") if _split(x)]
        grams = Counter(zip(own, own[1:], own[2:], strict=False))
        repeated = len({k + j for k in range(len(own) - 2) if grams[tuple(own[k : k + 3])] > 1 for j in range(3)})
        base = (len(own), sum(map(len, own)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), repeated)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base
        failed = len(own) < 50 or 100 * repeated > 50 * len(own)
        by_class = min(js(share(classes(text)), share(c)) for c in class_sums.values()) if base[1] >= 200 else None
        by_word = None
        if len(own) >= 50:
            counts = Counter(map(lower, own))
            by_word = 2.0
            for n, top in common.items():
                total, mine = sum(by_lang[n].values()), [counts[w] for w, _ in top]
                p, q = [x / len(own) for x in [*mine, len(own) - sum(mine)]], [x / total for x in [*(v for _, v in top), total - sum(v for _, v in top)]]
                by_word = min(by_word, js(p, q))
        close = lambda a, b: a is b is None or abs(a - b) < 1e-6
        assert close(r.class_distance, by_class) and close(r.word_distance, by_word)
        far = (by_class or 0) > rules.MAX_CLASS_DISTANCE or (by_word or 0) > rules.MAX_WORD_DISTANCE
        assert (r.base_failed, r.kept) == (failed, not failed and not far)


def _split(text):
    return [w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in text).split(" ") if w]


def test_rules_edges(spark):
    many = spark.createDataFrame([(f"alpha{k} beta{k} the the " * 20, f"l{k}") for k in range(70)], "text string, lang string")
    refs = rules.references(many)
    assert len(refs.words) == 70
    ties = rules.references(spark.createDataFrame([(" ".join(f"t{k:03d}" for k in range(100)), "x")], "text string, lang string"))
    assert [w.decode() for w in ties.words["x"][0]] == [f"t{k:03d}" for k in range(64)]  # equal counts: by name
    df = spark.createDataFrame([(1, None, True), (2, "", True), (3, "alpha3 beta3 the the " * 40_000, True), (3, None, True)], "doc_id long, text string, KEPT boolean")
    got = rules.judge(df, refs, ["doc_id", "KEPT"]).collect()
    assert got[0].__fields__[:2] == ["doc_id", "n_words"] and sorted(r.n_words for r in got) == [0, 0, 0, 160_000]
    assert rules.judge(df.limit(0), refs, ["doc_id"]).count() == 0


def test_mixing_weights_keys_and_sources(spark):
    assert mixing.whole_weights([0.9, 0.1, 0, 1]) == [9, 1, 0, 10]
    for bad in (-1, float("inf"), float("nan")):
        with pytest.raises(ValueError):
            mixing.whole_weights([bad])
    df = spark.createDataFrame([(k, s) for k, s in enumerate(["src0"] * 1000 + ["src1"] * 1000 + ["off"] * 50)], "doc_id long, source string")
    out = mixing.schedule(df, {"src0": 0.9, "src1": 0.1, "off": 0}, 1, 10).toPandas()
    assert len(out) == 2000 and set(out.source) == {"src0", "src1"}
    assert Counter(out[out.slot < 40].drop_duplicates("slot").source) == {"src0": 36, "src1": 4}
    # one key holds all rows of a source, and null keys another: buckets of equal keys are dealt on
    rows = [(1, "a", k % 3) for k in range(9000)] + [(None, None, 0)] * 9000 + [(k, "b", 0) for k in range(500)]
    out = mixing.schedule(spark.createDataFrame(rows, "doc_id long, source string, Block int").repartition(3), {None: 2}, 1, 16).toPandas()
    assert len(out) == len(rows) and "Block" not in out.columns and not out.duplicated(["slot", "place_in_block"]).any()
    assert out.slot.nunique() == out.slot.max() + 1 == 563 + 563 + 32
    # more sources than fit in an old table, against earliest deadlines by a plain loop
    names = [f"s{k:04d}" for k in range(1001)]
    weights = {"s0003": 5, "s0500": 3}
    own = [weights.get(n, 1) for n in names]
    q, done, order = sum(own), [0] * len(names), []
    for t in range(q):
        ready = [(-(-(done[i] + 1) * q // own[i]), i) for i in range(len(names)) if done[i] * q // own[i] <= t]
        order.append(min(ready)[1])
        done[order[-1]] += 1
    rows = [(i * 10 + k, n) for i, n in enumerate(names) for k in range(own[i])]
    out = mixing.schedule(spark.createDataFrame(rows, "doc_id long, source string"), weights, 1, 1).toPandas().sort_values("slot")
    assert out.source.tolist() == [names[i] for i in order] and out.slot.tolist() == out.due.tolist() == list(range(q))


def test_mixing_period_in_stretches(spark, monkeypatch):
    df = spark.createDataFrame([(k, "ab"[k % 2]) for k in range(400)], "doc_id long, source string")
    want = mixing.schedule(df, {"a": 7, "b": 4}, 1, 2).orderBy("doc_id").collect()
    monkeypatch.setattr(mixing, "STEP", 4)
    monkeypatch.setattr(mixing, "INNER", 3)
    monkeypatch.setattr(mixing, "STRETCH", 5)
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 8)
    monkeypatch.setattr(mixing, "GROUP", 2)
    assert mixing.schedule(df, {"a": 7, "b": 4}, 1, 2).orderBy("doc_id").collect() == want


def test_jaccard_late_rows_and_null_ids(spark):
    r = random.Random(9)
    passage = " ".join(f"p{k}" for k in range(100))
    rows = [(k, passage + " " + " ".join(f"o{k}_{j}" for j in range(r.choice([2, 6, 12, 13, 14, 18, 30])))) for k in range(120)]
    words = lambda t: t.split()
    sets = [{tuple(words(t)[k : k + 5]) for k in range(len(words(t)) - 4)} for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = {x.doc_id: x.component_id for x in jaccard.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == {i: find(i) for i in range(len(rows))}
    near = " ".join(f"n{k}" for k in range(80))
    bridge = [(None, near + " x"), (9, near), (None, near + " x"), (8, near + " x y z"), (None, "alone " + passage), (None, "b " + near + " q"), (None, None)]
    got = Counter(map(tuple, jaccard.jaccard_classes(spark.createDataFrame(bridge, "doc_id long, text string")).select("doc_id", "component_id").collect()))
    assert got == Counter([(None, 8), (9, 8), (None, 8), (8, 8), (None, None), (None, 8), (None, None)])
    nulls = spark.createDataFrame([(None, "a text without an id of its own here"), (None, "a text without an id of its own here"), (4, "a text without an id of its own here"), (None, None)], "doc_id long, text string")
    assert Counter(map(tuple, jaccard.jaccard_classes(nulls).collect())) == Counter([(None, 5, 4), (None, 5, 4), (4, 5, 4), (None, 0, None)])


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables")
def test_pipeline_equals_its_stages_by_hand(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    net = quality_cnn.fit(docs, labels)
    good = {i for i, r in rows.items() if quality_cnn.score(net, np.frombuffer((r.text or "").encode(), np.uint8)) >= quality_cnn.THRESHOLD}
    left = docs.where(F.col("doc_id").isin(*good))
    languages = langid.Languages(langid.fit(left))
    known = {i for i in good if not languages.judge((rows[i].text or "").encode())[2]}
    sets = {i: _shingles(rows[i].text) for i in known}
    lead = {i: i for i in known}

    def find(i):
        while lead[i] != i:
            i = lead[i]
        return i

    for i in known:
        for j in known:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                lead[max(a, b)] = min(a, b)
    kept = {i for i in known if find(i) == i}
    got = corpus_pipeline.run(spark, SMALL).toPandas()
    assert set(got.doc_id) == kept and got.round_trip.all()
    by_hand = mixing.schedule(docs.where(F.col("doc_id").isin(*kept)), mixing.WEIGHTS).select("doc_id", "slot", "place_in_block").toPandas()
    order = lambda d: d.sort_values("doc_id")[["doc_id", "slot", "place_in_block"]].values.tolist()
    assert order(got) == order(by_hand)


def _shingles(text):
    words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in _split(text or "")]
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def test_pipeline_of_nothing_and_of_nulls(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/a/labels.parquet")
    spark.createDataFrame([], kinds).write.parquet(f"{tmp_path}/a/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/a").count() == 0
    rows = [(1, None, None, None, None), (None, "", "en", "s", 0), (2, "a plain text of some words for the mix " * 9, "en", None, 1), (2, "another text under the same id, also plain " * 9, "en", None, 1), (None, "and one more text that has no id at all " * 9, "en", "s", 1)]
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/b/labels.parquet")
    spark.createDataFrame(rows, kinds).write.parquet(f"{tmp_path}/b/documents.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/b").toPandas()
    assert len(got) == 3 and got.round_trip.all() and sorted(got.slot) == [0, 0, 1]  # the two rows without a source are one block


def test_clusters_need_a_shared_folder(spark):
    from lodestone.llm import common

    class Conf(dict):
        def get(self, key, default=None):
            return default

    class Away:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://somewhere:7077"})()

    with pytest.raises(RuntimeError):
        common.shared_dir(Away())


def test_urls_edges(spark):
    from lodestone.llm import urls

    long = "http://" + ".".join(["a"] * 4000) + ".example.com/en/" + "d/" * 20_000 + "?q#f"
    rows = [(1, long, "h", "v"), (2, None, "h", "v"), (2, None, "h", "v"), (3, "http://example.com/en/7/" + "x" * 50_000, "h", "v")]
    df = spark.createDataFrame(rows, "page_id long, url string, Host string, verdict string")
    got = urls.judge(df, urls.rules_frame(spark, urls.RULES), ["page_id", "Host", "verdict"]).collect()
    assert got[0].__fields__ == ["page_id", "host", "path", "rule", "verdict"]
    assert sorted((r.page_id, r.rule, r.verdict) for r in got if r.rule) == [(1, "com/en/", "block"), (3, "example.com/en/7", "allow")]
    assert [(r.host, r.path, r.verdict) for r in got if r.page_id == 2] == [("", "", "allow")] * 2
    # equally long rules: allow stands before block, then the first by name
    tied = urls.rules_frame(spark, [("com/a", "block"), ("com/a", "allow"), (None, "block")])
    assert urls.judge(df.where("page_id = 3").withColumn("url", F.lit("http://com/a")), tied, ["page_id"]).first().verdict == "allow"
    assert urls.judge(df, tied.limit(0), ["page_id"]).where("verdict <> 'allow'").count() == 0


def test_components_of_a_long_path(spark):
    from lodestone.llm.components import components

    edges = spark.range(600).selectExpr("id as a", "id + 1 as b").union(spark.createDataFrame([(900, 950), (950, 900), (7, 7)], "a long, b long"))
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**{k: 0 for k in range(601)}, 900: 900, 950: 900}
    assert components(edges.limit(0)).count() == 0


def test_batches_are_gathered():
    import pyarrow as pa

    from lodestone.llm.common import gathered

    sizes = [3, 0, 4, 1, 9, 2]
    given = [pa.RecordBatch.from_pydict({"x": list(range(sum(sizes[:k]), sum(sizes[: k + 1])))}, schema=pa.schema([("x", pa.int64())])) for k in range(len(sizes))]
    out = list(gathered(iter(given), 5))
    assert [b.num_rows for b in out] == [7, 10, 2] and [v for b in out for v in b.column(0).to_pylist()] == list(range(19))
    assert list(gathered(iter([]), 5)) == []


def test_inner_names_may_be_taken(spark):
    from lodestone.llm import urls

    df = spark.createDataFrame([(1, "five words make one shingle", 7, 7, 7, 7, "a"), (2, "five words make one shingle", 8, 8, 8, 8, "b")], "doc_id long, text string, _node int, _id int, stays int, Slot int, _result string")
    kept = jaccard.survivors(df).collect()
    assert [tuple(r) for r in kept] == [(1, "five words make one shingle", 7, 7, 7, 7, "a")]
    assert quality_cnn.score_texts(df, quality_cnn.start(1), df.columns).columns == [*df.columns, "score"]
    assert sharding.assign(df).columns == [c for c in df.columns if c != "Slot"] + ["slot", "shard"]
    pages = spark.createDataFrame([(1, "http://x.com/en/", 5, 6)], "page_id long, url string, _best int, prefix int")
    got = urls.judge(pages, urls.rules_frame(spark, urls.RULES), ["page_id", "_best", "prefix"]).first()
    assert (got["_best"], got["prefix"], got["verdict"]) == (5, 6, "block")
