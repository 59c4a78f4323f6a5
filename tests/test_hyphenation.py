import random

import pytest

from tessitura.operators import hyphenation

ENGLISH = "hy3ph he2n hena4 hen5at 1na n2at 1tio 2io o2n".split()


def _plain(word: str, patterns: list[str], left: int, right: int) -> list[str]:
    """A trie of the patterns, walked from every place of the word."""
    trie: dict = {}
    for p in patterns:
        letters = [c for c in p.lower() if not c.isdigit()]
        weights, k = [0] * (len(letters) + 1), 0
        digits = ""
        for c in p.lower() + "\n":
            if c.isdigit():
                digits += c
            else:
                weights[k] = int(digits or 0)
                digits, k = "", k + 1
        node = trie
        for c in letters:
            node = node.setdefault(c, {})
        if letters:
            node["="] = [max(x) for x in zip(node.get("=", [0] * len(weights)), weights, strict=True)]
    edged = f".{word.lower()}."
    best = [0] * (len(edged) + 1)
    for s in range(len(edged)):
        node = trie
        for c in edged[s:]:
            node = node.get(c)
            if node is None:
                break
            for k, w in enumerate(node.get("=", [])):
                best[s + k] = max(best[s + k], w)
    breaks = [p for p in range(1, len(word)) if best[p + 1] % 2 and left <= p <= len(word) - right]
    return [word[a:b] for a, b in zip([0, *breaks], [*breaks, len(word)], strict=True)]


def _parts(spark, words, patterns, exceptions=None, **more):
    table = spark.createDataFrame([(w,) for w in words], "word string")
    listed = spark.createDataFrame([(e,) for e in exceptions], "parts array<string>") if exceptions is not None else None
    return [(r["word"], r["parts"]) for r in hyphenation.hyphenate(table, spark.createDataFrame([(p,) for p in patterns], "pattern string"), listed, **more).collect()]


def test_a_known_word(spark):
    assert _parts(spark, ["Hyphenation"], ENGLISH) == [("Hyphenation", ["Hy", "phen", "ation"])]


@pytest.mark.parametrize(("left", "right", "broadcast"), [(1, 1, True), (2, 3, False)])
def test_against_a_trie(spark, left, right, broadcast):
    r = random.Random(left)
    pattern = lambda: "".join(r.choice("abcé") + r.choice(["", "", "1", "2", "3", "10"]) for _ in range(r.randrange(1, 5)))
    patterns = [r.choice(["", "."]) + r.choice(["", "1", "4"]) + pattern() + r.choice(["", "", "."]) for _ in range(120)] + ["", "12", "a1b", "a3b"]
    words = ["".join(r.choice("abcéAB") for _ in range(r.randrange(1, 12))) for _ in range(300)] + ["a", "x" * 30]
    table = spark.createDataFrame([(w,) for w in words], "word string")
    rules = spark.createDataFrame([(p,) for p in patterns], "pattern string")
    got = {r["word"]: r["places"] for r in hyphenation.break_places(table, rules, left=left, right=right, broadcast=broadcast).collect()}
    for w in set(words):
        want = _plain(w, patterns, left, right)
        cut = [0, *got[w], len(w)]
        assert [w[a:b] for a, b in zip(cut, cut[1:], strict=False)] == want


def test_exceptions_and_edges(spark):
    got = _parts(spark, ["Coração", "coração", "", None, "hyphenation", "luz"], ENGLISH, [["co", "ra", "ção"], ["never", "met"]])
    assert sorted(map(repr, got)) == sorted(map(repr, [("Coração", ["Co", "ra", "ção"]), ("coração", ["co", "ra", "ção"]), ("", None), (None, None), ("hyphenation", ["hy", "phen", "ation"]), ("luz", ["luz"])]))
    assert _parts(spark, ["abc", "abc"], []) == [("abc", ["abc"])] * 2 and _parts(spark, [], ENGLISH) == []
    for wrong in ([["hy", "", "phen"]], [["a", "bc"], ["ab", "c"]]):
        with pytest.raises(Exception, match="no valid parts"):
            _parts(spark, ["hyphen", "abc"], ENGLISH, wrong)
    with pytest.raises(ValueError, match="word"):
        _parts(spark, ["a"], ENGLISH, into="word")
