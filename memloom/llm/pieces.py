"""Splitting oversized texts at natural boundaries.

Method: a recursive hierarchy of separators. A text larger than a piece may hold is split after its sections; a
section that is still too large after its paragraphs, then lines, sentences, clauses, words, punctuation within
words, and at last between characters (grapheme clusters, so that no visible character is torn). The units
found are packed greedily: a piece takes units until the next would not fit. Each piece from the second on begins
with the last ``overlap`` code points of the piece before, so its new part is at most ``limit - overlap`` long.

Plan: the size filter runs in the scan; only oversized texts reach Python, in Arrow batches; a text is split in
one task, in time linear in its length. No shuffle.

Defined results: null texts and texts within the limit give no piece; pieces cover the whole text, in order; a
separator stays with the unit before it; repeated rows are split alike; an image goes with the first piece that
holds its whole caption, or, where the caption is cut, with the piece in which it begins; an image without a
caption goes with the piece that holds its id, else with the last one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from memloom.session import ship

LIMIT, OVERLAP = 1000, 80

#: Separators from the coarsest to the finest; a unit ends behind one. All hold white space or punctuation of
#: ``_BREAKS``, so a stretch without both is never cut above the level of characters.
_LEVELS = (
    re.compile(r"\n[ \t]*(?:\r?\n[ \t]*){2,}|\n(?=#{1,6} |={3,}|-{3,}\s|[^\n]{1,60}:\r?\n- )"),  # sections
    re.compile(r"\n[ \t]*(?:\r?\n[ \t]*)+"),  # paragraphs
    re.compile(r"\r?\n|[  ]"),  # lines
    re.compile(r"[.!?…]+[\"'”’»)\]]*\s+|[。！？]+[」』”’）]*"),  # sentences
    re.compile(r"[;:,]\s+|[；：，、]|\s[–—-]\s"),  # clauses
    re.compile(r"\s+"),  # words
    re.compile(r"[.!?;:,。！？；：，、]+"),  # punctuation within words
)
_BREAKS = re.compile(r"[\s.!?;:,。！？；：，、]+")


def _clusters(text: str, a: int, b: int) -> Iterator[int]:
    """Ends of the grapheme clusters of text[a:b]."""
    import regex

    for m in regex.finditer(r"\X", text[a:b]):
        yield a + m.end()


def unit_ends(text: str, room: int) -> tuple[list[int], list[int]]:
    """Ends of the units none of which is longer than ``room``, and the lengths of the stretches that had to
    be cut between characters."""
    ends: list[int] = []
    cut: list[int] = []

    def split(a: int, b: int, level: int) -> None:
        while b - a > room:
            if level == len(_LEVELS):
                cut.append(len(_BREAKS.sub("", text[a:b])))
                ends.extend(e for e in _clusters(text, a, b))
                return
            marks = [m.end() for m in _LEVELS[level].finditer(text, a, b)]
            level += 1
            if marks and marks[-1] == b:
                marks.pop()
            if marks:
                for x, y in zip([a, *marks], [*marks, b]):
                    split(x, y, level)
                return
        ends.append(b)

    split(0, len(text), 0)
    return ends, cut


def piece_spans(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> tuple[list[tuple[int, int]], bool]:
    """(start, end) of each piece, and whether a stretch longer than ``limit`` had to be cut between characters."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be smaller than limit")
    if len(text) <= limit:
        return ([(0, len(text))] if text else []), False
    ends, cut = unit_ends(text, limit - overlap)
    spans: list[tuple[int, int]] = []
    start = done = 0

    def close(end: int) -> None:
        nonlocal start, done
        spans.append((start, end))
        start, done = end - overlap if end > overlap else 0, end

    packed = 0
    for e in ends:
        while e - start > limit:
            # A cluster longer than a piece is cut between code points.
            close(packed if packed > done else start + limit)
            packed = max(packed, done)
        packed = e
    if packed > done:
        close(packed)
    return spans, any(n > limit for n in cut)


def image_pieces(text: str, spans: list[tuple[int, int]], images: list[dict] | None) -> list[list[dict]]:
    """The images of each piece."""
    out: list[list[dict]] = [[] for _ in spans]
    seen: dict[str, int] = {}
    for im in images or []:
        if im is None:
            continue
        caption, ident = im.get("caption"), im.get("id")
        at, size = -1, 0
        for label in ([f"{ident} | {caption}"] if ident and caption else []) + [x for x in (caption, ident) if x]:
            at = text.find(label, seen.get(label, 0))
            if at < 0:
                at = text.find(label)
            if at >= 0:
                seen[label] = at + 1
                if caption and label.endswith(caption):
                    at, size = at + len(label) - len(caption), len(caption)
                else:
                    size = len(label)
                break
        where = len(spans) - 1
        if at >= 0:
            whole = (k for k, (a, b) in enumerate(spans) if a <= at and at + size <= b)
            begins = (k for k, (a, b) in enumerate(spans) if a <= at < b)
            where = next(whole, next(begins, where))
        out[where].append(im)
    return out


def split_oversized(df: DataFrame, keep: list[str], text: str = "text", images: str | None = None, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The pieces of every text with more than ``limit`` code points: ``keep`` columns, piece (from 0), n_pieces,
    start, end, piece_text, forced, and the piece's images where ``images`` names an array of image structs."""
    ship(df.sparkSession)
    big = df.filter(F.length(F.col(f"`{text}`").cast("string")) > limit)
    cols = [F.col(f"`{c}`") for c in keep]
    extra = [F.col(f"`{images}`").alias("__images")] if images else []
    slim = big.select(*cols, F.col(f"`{text}`").cast("string").alias("__text"), *extra)
    n = len(keep)
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in slim.schema.fields[:n])
    fields += "piece int, n_pieces int, start int, end int, piece_text string, forced boolean"
    if images:
        fields += f", images {slim.schema.fields[n + 1].dataType.simpleString()}"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(n).to_pylist()
            pics = b.column(n + 1).to_pylist() if images else None
            rows, out, carried = [], [], []
            for r, t in enumerate(texts):
                spans, forced = piece_spans(t, limit, overlap)
                for k, (a, e) in enumerate(spans):
                    rows.append(r)
                    out.append((k, len(spans), a, e, t[a:e], forced))
                if images:
                    carried.extend(image_pieces(t, spans, pics[r]))
            take = pa.array(rows, pa.int64())
            done = [b.column(k).take(take) for k in range(n)]
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.bool_())
            done += [pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)]
            names = [*b.schema.names[:n], "piece", "n_pieces", "start", "end", "piece_text", "forced"]
            if images:
                done.append(pa.array(carried, b.column(n + 1).type))
                names.append("images")
            yield pa.RecordBatch.from_arrays(done, names=names)

    return slim.mapInArrow(work, fields)
