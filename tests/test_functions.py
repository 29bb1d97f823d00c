from lodestone.functions.chunker import chunks, sentences
from lodestone.functions.text import batch_size, key_variable, match_expression, query_tokens


def test_sentences_respect_decimals_parentheses_and_scripts():
    assert [s for s, _ in sentences("One is 3.14 long. Two follows.\n\nThree")] == ["One is 3.14 long.", "Two follows.", "Three"]
    assert len(sentences("See (Gosea. Stanford) here. Then there.")) == 2
    assert [s for s, _ in sentences("첫 문장입니다. 둘째예요. 셋째")] == ["첫 문장입니다.", "둘째예요.", "셋째"]
    assert [s for s, _ in sentences("一。二。三")] == ["一。", "二。", "三"]


def test_chunks_overlap_merge_and_limits():
    assert chunks(None) == chunks("") == chunks(" \n ") == []
    assert chunks("short") == [("short", 0)]
    text = " ".join(f"Sentence number {i} has some words." for i in range(20))
    found = chunks(text, 100, 20)
    assert len(found) > 3 and all(len(c) <= 160 for c, _ in found)
    first, second = found[0][0], found[1][0]
    assert second.split(" ")[0] in first.split(" ")
    assert "".join(c for c, _ in chunks("x" * 9000)) == "x" * 9000
    assert [len(c) for c, _ in chunks("x" * 9000)] == [4000, 4000, 1000]
    assert [o for _, o in chunks("x" * 9000)] == [0, 4000, 8000]
    # a short tail joins the chunk before it
    assert len(chunks("A" * 90 + ". " + "Bc.", 92, 0)) == 1


def test_query_and_lookups():
    assert query_tokens("ab abc  x\U0001f600") == ["abc"]
    assert match_expression('say "hi" now') == '"say" OR """hi""" OR "now"'
    assert batch_size("OpenAI", "text-embedding-3-small") == 512 and batch_size("x", "y") == 256
    assert key_variable("claude") == "ANTHROPIC_API_KEY" and key_variable(" ") is None
