import sqlite3

import pytest

from lodestone.operators import search, textindex
from lodestone.operators.search import bm25_scores, candidates, hybrid, knn_topk, postings, rrf, top

DOCS = [("a1", "The quick brown fox aaaaa"), ("b2", "quick Quick café fox"), ("c3", "nothing here at all"), ("d4", "배터리 용량 battery cell"), ("e5", "aaa 100% [x] a.c")]


@pytest.mark.parametrize("query", ["quick", "fox quick", "quick quick", "aaa", "café", "cafe", "배터리", "ab", "a.c", "[x]", "zzz"])
def test_bm25_equals_sqlite(spark, query):
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(chunk_id, content, tokenize='trigram')")
    con.executemany("insert into t values (?, ?)", DOCS)
    words = [w for w in query.split() if len(w) >= 3]
    want = {}
    if words:
        want = dict(con.execute("select chunk_id, -bm25(t) from t where t match ?", (" OR ".join(f'"{w}"' for w in words),)))
    got = {r.chunk_id: r.score for r in bm25_scores(spark.createDataFrame(DOCS, "chunk_id string, content string"), query).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_vectors_fusion_and_modes(spark):
    v = spark.createDataFrame([("a", "m", [1.0, 0.0]), ("b", "m", [0.9, 0.1]), ("c", "m", [0.0, 1.0]), ("z", "m", [0.0, 0.0]), ("s", "m", [1.0])], "chunk_id string, model string, embedding array<float>")
    assert [r.chunk_id for r in knn_topk(v, [1.0, 0.0], 5, 0.5).collect()] == ["a", "b"]
    lists = [spark.createDataFrame([("x", 0), ("y", 1)], "chunk_id string, rank int"), spark.createDataFrame([("y", 0), ("w", 1)], "chunk_id string, rank int")]
    fused = rrf(lists, 3).orderBy("rank").collect()
    assert [r.chunk_id for r in fused] == ["y", "x", "w"] and abs(fused[0].score - (1 / 62 + 1 / 61)) < 1e-12
    chunks = spark.createDataFrame([("a", "plain words", None), ("b", "other", "enriched battery"), ("c", "last", None)], "id string, content string, enriched string")
    mode = lambda **k: {r.search_mode for r in hybrid(chunks, v, query_vector=[1.0, 0.0], **k).collect()}
    assert mode(query="battery") == {"hybrid"} and mode(query="absent") == {"vector_only"} and mode(query="battery", mode="bm25") == {"bm25_only"}
    assert {r.search_mode for r in hybrid(chunks, None, "battery", None).collect()} == {"bm25_only"}
    with pytest.raises(ValueError):
        hybrid(chunks, None, "battery", None, mode="vector")


def test_postings_find_all_matches(spark):
    df = spark.createDataFrame(DOCS, "chunk_id string, content string")
    index = postings(df)
    assert {r.chunk_id for r in candidates(index, "quick").collect()} == {"a1", "b2"}
    assert candidates(index, "ab").count() == 0
    assert index.where("trigram = 'aaa' and chunk_id = 'a1'").first().tf == 3
    assert top(bm25_scores(df, "quick"), 1).count() == 1


def test_posting_sizes_add_up_in_tasks(spark, monkeypatch):
    """Sums of all postings, for any number held at once, and few rows leave a task."""
    rows = [*DOCS, ("f6", None), ("g7", ""), ("h8", "ab"), ("i9", "𝒳𝒴𝒵𝒳𝒴𝒵 aaaa")] + [(f"x{k}", "the same words " * 50) for k in range(200)]
    df = spark.createDataFrame(rows, "chunk_id string, content string").coalesce(1)
    want = {}
    for _, text in rows:
        own = [(text or "").lower()[k : k + 3] for k in range(len(text or "") - 2)]
        for g in set(own):
            n, tf = want.get(g, (0, 0))
            want[g] = (n + 1, tf + own.count(g))
    assert search._task_sums(df, "content").count() == len(want) < postings(df).count() / 10
    for held in (search.HELD_GRAMS, 50):
        monkeypatch.setattr(search, "HELD_GRAMS", held)
        assert {r.trigram: (r.df, r.tf) for r in search.posting_sizes(df).collect()} == want
    assert spark.createDataFrame([], df.schema).transform(search.posting_sizes).count() == 0
    assert {r.trigram: r.n for r in postings(df).groupBy("trigram").count().withColumnRenamed("count", "n").collect()} == {g: n for g, (n, _) in want.items()}


def test_word_postings_are_all_words(spark, monkeypatch):
    """Words as str.split cuts them, counted per chunk, whatever the sizes of batches."""
    from collections import Counter

    texts = ["", None, " \x1c a\x85b　c\xa0a \n", "x" * 3000 + " a", "배터리 ​ a A"] + [f"w{k % 7} w{k % 3} w{k % 7}" for k in range(40)]
    rows = [(f"C{k:02}", t) for k, t in enumerate(texts)] + [(None, "a lone")]
    df = spark.createDataFrame(rows, "chunk_id string, content string").coalesce(1)
    want = Counter((w, c, n) for c, t in rows for w, n in Counter([*(t or "").lower().split(), *(c or "").lower().split()]).items())
    want = {(w, "" if c is None else c, n) for w, c, n in want}
    for chunks, chars in ((textindex.BATCH_CHUNKS, textindex.BATCH_CHARS), (4, 1 << 20), (4096, 50)):
        monkeypatch.setattr(textindex, "BATCH_CHUNKS", chunks)
        monkeypatch.setattr(textindex, "BATCH_CHARS", chars)
        held = textindex.postings(textindex.indexed_rows(df)).collect()
        names = {(r.batch, r.places[0]): (r.chunk_id or "", r.dls[0]) for r in held if r.word == ""}
        got = [(r.word, names[r.batch, p][0], n) for r in held if r.word for p, n in zip(r.places, r.tfs, strict=True)]
        assert len(names) == len(rows) and len(got) == len(set(got)) and set(got) == want
        assert all(names[r.batch, p][1] == d for r in held for p, d in zip(r.places, r.dls, strict=True)) and all(r.n == len(r.places) for r in held)


def test_matches_of_a_large_index_are_computed_once(spark, monkeypatch, tmp_path):
    """More chunks with a token than come to the driver: they are held, not looked for again."""
    df = spark.createDataFrame([(f"c{k:03}", "quick " * (k % 5 + 1) + "brown") for k in range(300)] + [(f"d{k:03}", "slow") for k in range(400)], "chunk_id string, content string")
    rows = textindex.postings(textindex.indexed_rows(df)).localCheckpoint()
    seen = f"{tmp_path}/seen"  # a file, as tasks that a limit ends early lose their accumulators
    found_in = textindex.found_in

    def counting(batches):
        for b in batches:
            with open(seen, "a") as f:
                f.write(f"{b.num_rows}\n")
            yield b

    def counted(*given):
        found = found_in(*given)
        return found.mapInArrow(counting, found.schema)

    monkeypatch.setattr(textindex, "found_in", counted)
    monkeypatch.setattr(textindex, "READ_WHOLE", 100)
    monkeypatch.setattr(textindex, "HELD", 20)
    got = [(r.chunk_id, round(r.score, 9), r["rank"]) for r in textindex.bm25_top(rows, "quick", 7).collect()]
    assert got == [(r.chunk_id, round(r.score, 9), r["rank"]) for r in search.bm25_topk(df, "quick", 7).collect()]
    assert sum(map(int, open(seen))) == 300
