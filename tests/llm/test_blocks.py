from pulsegrid.llm.blocks import text_blocks


def test_blocks():
    texts = ["a" * 5, None, "b" * 20, "", "c" * 3, "d" * 3, "e" * 3]
    for docs, chars in ((2, 100), (100, 8), (1, 1), (100, 100)):
        got = list(text_blocks(texts, docs, chars))
        assert [x for a, b in got for x in range(a, b)] == list(range(7))
        assert all(b - a <= docs and (b - a == 1 or sum(len(t or "") for t in texts[a:b]) <= chars) for a, b in got)
    assert list(text_blocks([])) == []
