import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leafmill.llm.split import cut_points, pieces_of, split_texts


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["word", "a", "é", " ", "  ", "\n", "\n\n", ". ", ", ", "| x |", "longword" * 5, "é"]), max_size=200).map("".join))
def test_pieces_are_small_overlap_exactly_and_lose_nothing(text):
    limit, overlap = 60, 10
    pieces = pieces_of(text, limit, overlap)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    assert all(b - a <= limit for a, b in pieces)
    assert all(b - c == overlap for (_, b), (c, _) in zip(pieces, pieces[1:], strict=False))
    joined = "".join(text[a + (overlap if i else 0) : b] for i, (a, b) in enumerate(pieces))
    assert joined == text


def plain_merge(text, limit, overlap):
    """The same rule without a heap: always merge the weakest boundary that still fits."""
    from leafmill.llm import split

    found = [(m.end(), split._STRENGTH[m.lastgroup]) for m in split._BOUNDARY.finditer(text) if overlap <= m.end() < len(text)]
    segs, levels, last = [], [], 0
    for end, level in [*found, (len(text), None)]:
        segs.append((last, end))
        levels.append(level)
        last = end
    while True:
        fits = [(levels[i], segs[i + 1][1] - segs[i][0], i) for i in range(len(segs) - 1) if segs[i + 1][1] - segs[i][0] + overlap <= limit]
        if not fits:
            return [s for s, _ in segs[1:]]
        _, _, i = min(fits)
        segs[i : i + 2] = [(segs[i][0], segs[i + 1][1])]
        levels[i : i + 1] = []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["word", "a", " ", "\n", "\n\n", ". ", ", "]), min_size=30, max_size=150).map("".join))
def test_heap_merging_is_the_plain_rule(text):
    limit, overlap = 40, 6
    if len(text) > limit and max(map(len, text.split() or [""])) < 30:
        assert cut_points(text, limit, overlap) == plain_merge(text, limit, overlap)


def test_strong_boundaries_survive():
    text = "One two three. " * 70 + "\n\n" + "Four five six. " * 70
    assert cut_points(text) == [1052]


def test_character_clusters_stay_whole():
    text = "é" * 3000
    assert all(c % 2 == 0 for c in cut_points(text))


def test_rows(spark):
    rows = [(1, "x" * 5000, 0), (1, "x" * 5000, 0), (2, "short", 0), (3, None, 0), (4, "", 0), (5, "y " * 1000, 0), (6, "é" * 2001, 0), (7, "w " * 500_000, 0)]
    df = spark.createDataFrame(rows, "id int, t string, piece int")
    got = split_texts(df, "id", "t").collect()
    by = {}
    for r in got:
        by.setdefault(r.id, []).append(r)
    assert [r.piece for r in by[2] + by[3] + by[4]] == ["short", None, ""] and len(by[5]) == 1 and len(by[6]) == 2
    for i, text in ((1, "x" * 5000), (7, "w " * 500_000)):
        ps = sorted(by[i], key=lambda r: r.piece_no)
        assert [p.piece_no for p in ps] == list(range(len(ps))) and all(len(p.piece) <= 2000 for p in ps)
        assert "".join(p.piece[150 if p.piece_no else 0 :] for p in ps) == text
    assert {r.id for r in split_texts(df, "id", "t", only_oversized=True).collect()} == {1, 6, 7}
    assert split_texts(df.limit(0), "id", "t").count() == 0
    with pytest.raises(ValueError, match="overlap"):
        split_texts(df, "id", "t", 100, 100)
