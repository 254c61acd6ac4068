import re

import pytest
from hypothesis import given, settings, strategies as st

from memloom.llm import pieces

BREAK = re.compile(r"[^\s.!?;:,。！？；：，、]{1001,}")


def check(text, limit, overlap):
    spans, _ = pieces.piece_spans(text, limit, overlap)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(0 < b - a <= limit for a, b in spans)
    for (_, b), (c, e) in zip(spans, spans[1:]):
        assert c == max(0, b - overlap) and e > b
    return spans


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "bc ", ". ", "\n\n", "\r\n", "é", "👩‍🌾", "x" * 30, "。", ", ", "é" * 9]), min_size=1, max_size=120), st.integers(5, 60))
def test_pieces_cover_the_text(parts, limit):
    check("".join(parts), limit, limit // 4)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from(["a" * 400, "b" * 700, " ", ".", "、", "c" * 1001]), min_size=3, max_size=8))
def test_forced(parts):
    text = "".join(parts)
    assert len(text) <= 1000 or pieces.piece_spans(text)[1] == bool(BREAK.search(text))


def test_natural_boundaries():
    text = "First sentence here. Second one follows it.\n\nNew paragraph now, with a clause. " * 5
    for _, end in check(text, 100, 10)[:-1]:
        assert text[end - 1] in " \n"


def test_one_huge_cluster_and_white_space():
    check("e" + "́" * 5000, 1000, 80)
    check(" " * 3000, 1000, 80)
    check("\r\n" * 1500, 1000, 80)
    with pytest.raises(ValueError):
        pieces.piece_spans("x" * 50, 10, 10)


def test_images_and_dirty_rows(spark):
    image = "struct<id:string,caption:string>"
    text = "word " * 250 + "\nPictures:\n- i1 | a red tent\n- i2 | a red tent\n- i3 | the end"
    rows = [
        (1, text, [("i1", "a red tent"), ("i2", "a red tent"), ("i3", "the end"), ("i4", None)], "x"),
        (2, "short", [("i1", "short")], None),
        (3, None, None, None),
        (4, "y" * 1500, None, None),
        (4, "y" * 1500, [], None),
    ]
    df = spark.createDataFrame(rows, f"row_id bigint, text string, images array<{image}>, piece string")
    out = pieces.split_oversized(df, ["row_id"], images="images").collect()
    assert {r.row_id for r in out} == {1, 4}
    carried = [i.id for r in sorted((r for r in out if r.row_id == 1), key=lambda r: r.piece) for i in r.images]
    assert carried == ["i1", "i2", "i3", "i4"]
    for r in out:
        for i in r.images:
            assert i.caption is None or i.caption in r.piece_text
    assert [r.forced for r in out if r.row_id == 4] == [True] * 4
    assert pieces.split_oversized(df.limit(0), ["row_id"]).count() == 0


def test_whole_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/turns.parquet")
    want = {r.row_id: int(bool(BREAK.search(r.text))) for r in df.filter("length(text) > 1000").collect()}
    got = {r.row_id: int(r.forced) for r in pieces.split_oversized(df, ["row_id"]).filter("piece = 0").collect()}
    assert got == want
