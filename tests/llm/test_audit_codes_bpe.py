"""Operators 11 to 13 against the library, plain versions of their own, and edge cases."""

import math
import os
import random
from hashlib import sha256
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import Row

from lodestone.llm import filter_audit, pieces, queries, vector_codes, word_bpe

DATA = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
hexed = lambda s: sha256(s.encode()).hexdigest()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(word_bpe.MODEL)


def _ids(bpe, text):
    words = list(bpe.words(text))
    return bpe.ids_of(words)[0].tolist() if words else []


@needs_data
def test_bpe_of_all_documents_equals_the_library(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.op11_word_bpe(spark, DATA).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.ids or []) == want and r.n_tokens == len(want)
        assert r.ids_sha256 == hexed(" ".join(map(str, want))) and r.decoded_sha256 == hexed(library.decode(want, skip_special_tokens=False))


def test_bpe_of_odd_texts_equals_the_library(library):
    r, bpe = random.Random(1), word_bpe.WordBpe(word_bpe.MODEL)
    texts = ["", " ", "it's ''s o'clock'll 'RE've", "a<|endoftext|>b<|startoftext|><|endoftext", "ΑΣ Σ aΣ", "İ ſ ǅ ﬁ", "日本語のテキスト" * 30, "é é̖", "1234 ½ ²³ ٣", "a\x85b\x1cc​ d　e", "՘ ᲊ \U00032400 ࢘́", "x" * 200 + "ab" * 300, "\0\x7f"]
    alphabet = "abcdefg 'stréΣ1!?<|>́日\U0001f600࢘﻿\n\x1cա"
    texts += ["".join(r.choice(alphabet) for _ in range(r.randint(1, 150))) for _ in range(1500)]
    assert all(_ids(bpe, t) == library.encode(t, add_special_tokens=False).ids for t in texts)
    # characters of the ranges that the plain pattern judges, one by one and before marks
    for c in [*range(0x530), *range(0x1E00, 0x2071), *range(0x3000, 0xA000, 7), *range(0xAC00, 0xD7A4, 97)]:
        t = f"1{chr(c)}b !{chr(c)}? a{chr(c)}́ a{chr(c)}̖"
        assert _ids(bpe, t) == library.encode(t, add_special_tokens=False).ids, hex(c)


def test_bpe_trees_equal_plain_merging(library, monkeypatch):
    bpe, r = word_bpe.WordBpe(word_bpe.MODEL), random.Random(2)

    def plain(symbols):
        symbols = list(symbols)
        while True:
            found = [(k, i) for i in range(len(symbols) - 1) if (k := bpe.merges.rank_of.get(symbols[i] * bpe.merges.size + symbols[i + 1])) is not None]
            if not found:
                return symbols
            rank, i = min(found)
            symbols[i : i + 2] = [int(bpe.merges.result[rank])]

    for n in (1, 2, 3, 7, 8, 33, 64, 65, 130):
        for _ in range(20):
            word = [*(int(bpe.inner[r.choice(b"aeinrst")]) for _ in range(n - 1)), int(bpe.last[r.choice(b"aeinrst")])]
            want = plain(word)
            assert bpe.merges.merge_one(word) == want
            width = 1 << (n - 1).bit_length()
            many = bpe.merges.merge_many(np.array([word + [-1] * (width - n)] * 3))
            assert all([s for s in row if s >= 0] == want for row in many.tolist())
    # stretches and forgotten words change nothing
    text = "some words of a text, and more. " * 60 + "unbroken" * 900
    whole = _ids(bpe, text)
    assert whole == library.encode(text, add_special_tokens=False).ids
    monkeypatch.setattr(word_bpe, "STRETCH", 50)
    monkeypatch.setattr(word_bpe, "WORDS_KEPT_BYTES", 500)
    assert sum((bpe.ids_of([x])[0].tolist() for x in bpe.words(text)), []) == whole


def test_bpe_frames(spark, library, tmp_path):
    rows = [(1, None, "x"), (2, "", "x"), (3, "Two  words", "x"), (3, "Two  words", "x"), (4, "y" * 70_000 + " z" * 30_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, N_TOKENS string")
    got = sorted(word_bpe.encode_texts(df, df.columns).collect(), key=lambda r: r.doc_id)
    assert got[0].__fields__ == ["doc_id", "text", "ids", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert got[0].ids is None and got[1].ids == [] and {(r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got[:2]} == {(0, hexed(""), hexed(""))}
    assert got[2] == got[3] and got[4].ids == library.encode(rows[4][1], add_special_tokens=False).ids
    back = word_bpe.decode_ids(word_bpe.encode_texts(df, ["doc_id"]), ["doc_id"]).collect()
    assert all(b.text is None if g.ids is None else hexed(b.text) == g.decoded_sha256 for b, g in zip(sorted(back), got, strict=True))
    assert word_bpe.encode_texts(df.limit(0), ["doc_id"]).count() == 0
    odd = spark.createDataFrame([([None, 320, 10**6, -1],)], "ids array<int>")
    assert word_bpe.decode_ids(odd, []).first().text == library.decode([320], skip_special_tokens=False)
    name = pieces.ship(spark, word_bpe.MODEL)
    assert word_bpe.encode_texts(df.where("doc_id = 3"), ["doc_id"], name).first().ids == got[2].ids
    other = tmp_path / "other.json"
    other.write_text(open(word_bpe.MODEL).read().replace('"Lowercase"', '"StripAccents"'))
    with pytest.raises(ValueError):
        word_bpe.WordBpe(str(other))


def _slow_audit(docs, labels):
    """Orders walked through, document by document."""
    words = lambda t: "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in t).split(" ")
    fails = []
    for d, t, _ in docs:
        t = t or ""
        w = [x for x in words(t) if x]
        own = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), "D": any(c in "#$%&*|" for c in t)}
        own["E"] = d is not None and any(e is not None and e < d and (u or "") == t for e, u, _ in docs)
        fails.append(own)
    marked = lambda d, k: d is not None and any(row[0] == d and row[k] == 1 for row in labels)
    out, shapley = {}, {}
    for part in {s or "" for _, _, s in docs}:
        mine = [k for k, (_, _, s) in enumerate(docs) if (s or "") == part]
        for order in permutations("ABCDE"):
            left = set(mine)
            for step, f in enumerate(order, 1):
                gone = {k for k in left if fails[k][f]}
                early = sum(fails[k][f] for k in mine if k not in left)
                left -= gone
                alone = sum(fails[k][f] and sum(fails[k].values()) == 1 for k in mine)
                out[part, "".join(order), step] = [len(left), len(gone), early, alone, *(sum(marked(docs[k][0], c) for k in gone) for c in (1, 2))]
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


@pytest.mark.parametrize("share", [1000, 3])  # most copies by broadcast, or by shuffle
def test_audit_equals_orders_walked_through(spark, share, monkeypatch):
    monkeypatch.setattr(filter_audit, "HOT_SHARE", share)
    monkeypatch.setattr(filter_audit, "PARTS_HELD", 1)
    r = random.Random(8)
    texts = [None, "", "one", "A B C # d", "w " * 250, " ".join(f"w{k}" for k in range(240)), " ".join(f"W{k}\t|" for k in range(240)), "same\x0bwords\r" * 130, "É" * 30 + "Z", "x" * 50_000]
    docs = [(r.choice([None, *range(40)]), r.choice(texts), r.choice([None, "", "a", "b"])) for _ in range(150)]
    docs += [(5, "one", "a")] * 3
    labels = [(k, r.choice([0, 1, None]), r.choice([0, 1, None])) for k in range(0, 40, 2)] + [(2, 1, 0), (2, 0, 1), (None, 1, 1), (999, 1, 1)]
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, source string, fails int, part string").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(x.part, x.filter_order, x.step): (x.kept, x.removed, x.redundant, x.unique_fails, x.good_lost, x.toxic_lost, x.shapley) for x in filter_audit.audit(frame, marks).collect()}
    assert got == _slow_audit(docs, labels)


def test_audit_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(none, labels).count() == 0
    one = spark.createDataFrame([(1, "word " * 300, None)], "doc_id long, text string, source string")
    rows = filter_audit.audit(one, labels).collect()
    assert len(rows) == 600 and {(x.kept, x.removed) for x in rows if x.filter_order.index("B") >= x.step} == {(1, 0)}


def test_audit_bitsets_by_loops():
    r = np.random.default_rng(3)
    part, fails = r.integers(0, 4, 1000), r.integers(0, 32, 1000)
    good, toxic = r.random(1000) < 0.3, r.random(1000) < 0.1
    got = filter_audit.counted(part, 4, fails, good, toxic)
    for p in range(4):
        for k, (before, f) in enumerate(filter_audit._STEPS):
            own = part == p
            hit, early = fails >> f & 1 == 1, fails & before != 0
            want = [own & ~early & ~hit, own & hit & ~early, own & hit & early, own & (fails == 1 << f), own & hit & ~early & good, own & hit & ~early & toxic]
            assert got[p, k].tolist() == [int(w.sum()) for w in want]


def _floor(x):
    top, below = float(x).as_integer_ratio()
    return vector_codes.SCALE * top // below


def _slow_codes(rows, parts, entries, rounds):
    """Rows (id, vector, label) by Python's integers; as the operator's rows, in a list."""
    kept = [(i, [_floor(x) for x in v], c, list(v)) for i, v, c in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted((k for k in kept if k[0] is not None), key=lambda k: (k[0], k[3]))
    width = len(named[0][3]) if named else 0
    own = [k for k in kept if named and len(k[3]) == width]
    d = width // parts
    cut = lambda v: [v[p * d : (p + 1) * d] for p in range(parts)]
    books = [[cut(k[1])[p] for k in [k for k in named if len(k[3]) == width][:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    best = lambda p, x: min(range(len(books[p])), key=lambda e: (far(x, books[p][e]), e))
    for _ in range(rounds):
        new = [list(b) for b in books]
        for p in range(parts):
            groups = {}
            for k in own:
                groups.setdefault(best(p, cut(k[1])[p]), []).append(cut(k[1])[p])
            for e, group in groups.items():
                new[p][e] = [sum(c) // len(group) for c in zip(*group, strict=True)]
        books = new
    digest = hexed(",".join(str(x) for b in books for e in b for x in e))
    out, sums = [], {}
    for i, v, c, _ in kept:
        fits = named and len(v) == width
        codes = [best(p, x) for p, x in enumerate(cut(v))] if fits else None
        error = min(vector_codes.LONG, sum(far(x, books[p][codes[p]]) for p, x in enumerate(cut(v)))) if fits else None
        out.append([i, "".join(f"{e:02x}" for e in codes) if fits else None, error, c])
        if fits:
            sums[c] = min(vector_codes.LONG, sums.get(c, 0) + error)
    return [(i, code, error, sums.get(c), digest) for i, code, error, c in out]


@pytest.mark.parametrize("large", [1.0, 60000.0, 1e30])
def test_codes_equal_plain_integers(spark, large, monkeypatch):
    monkeypatch.setattr(vector_codes, "HOT_SHARE", 4)
    r = random.Random(int(large))
    points = [[r.choice([0.0, 0.25, -0.5, r.uniform(-1, 1), r.uniform(-large, large)]) for _ in range(8)] for _ in range(40)]
    rows = [(r.choice([None, *range(60)]), [float(np.float32(x)) for x in r.choice(points)], r.choice([None, 1, 2, 3])) for _ in range(120)]
    rows += [(0, None, 1), (1, [math.nan] * 8, 1), (2, [1.0] * 7 + [math.inf], 1), (3, [None] * 8, 1), (70, [1.0] * 4, 9), (71, [], None), (5, rows[0][1], 4), (5, rows[0][1], 4)]
    df = spark.createDataFrame([(*x, "clash", 0) for x in rows], "vec_id long, embedding array<float>, label int, code string, error int").repartition(3)
    got = [tuple(x) for x in vector_codes.compress(df, parts=4, entries=6).collect()]
    key = lambda x: tuple((v is None, str(v)) for v in x)
    assert sorted(got, key=key) == sorted(_slow_codes(rows, 4, 6, 2), key=key)


def test_codes_edges(spark):
    kind = "vec_id long, embedding array<double>, label int"
    make = lambda rows: spark.createDataFrame(rows, kind)
    assert vector_codes.compress(make([])).count() == 0 and vector_codes.compress(make([(1, None, 1)])).count() == 0
    alone = vector_codes.compress(make([(None, [1.0] * 16, 1)])).first()
    assert alone.code is None and alone.error is None
    with pytest.raises(ValueError):
        vector_codes.compress(make([(1, [1.0] * 17, 1)]))
    one = vector_codes.compress(make([(1, [-0.001] * 16, None)])).first()
    assert one == Row(vec_id=1, code="00" * 16, error=0, label_error=0, codebooks_sha256=hexed(",".join(["-1"] * 16)))


def test_codes_screening_never_loses_the_best():
    r = np.random.default_rng(5)
    for size in (2, 100, 1 << 14, 1 << 24):
        for d in (1, 4, 9):
            x, book = r.integers(-size, size, (800, d)), r.integers(-size, size, (64, d))
            book[40] = book[7]
            x[:100] = (book[r.integers(0, 64, 100)] + book[r.integers(0, 64, 100)]) // 2  # near ties
            far = ((x[:, None, :] - book[None]) ** 2).sum(axis=2)
            maybe = vector_codes.candidates(x, book)
            assert maybe[np.arange(len(x)), far.argmin(axis=1)].all() and (vector_codes.nearest(x, book) == far.argmin(axis=1)).all()
