"""Text of PDF layout in plain Python, for use inside Arrow functions: glyphs, lines, blocks."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

#: After these signs a line or block always ends a word; what opens a list item.
CLOSING = ".?!>)]”’'\",;:"
ITEM = re.compile(r"\d+\.|[①-⑳]")
#: A glyph's width by its size where no box is given; a gap that parts words and a step that parts lines.
GLYPH_WIDTH, WORD_GAP, LINE_STEP = 0.55, 0.35, 0.5
#: How near the edges a broken word's parts stand, by glyph size and cell width, and by column width.
CELL_EDGE, COLUMN_EDGE, NARROW = (0.5, 0.1), 0.08, 100

Glyph = tuple[float, float, str, float, float]  # y, left, sign, size, right
Box = tuple[float, float, float, float]


def span_glyphs(span: dict) -> Iterator[Glyph]:
    """The glyphs of a span: its own ones, without line ends and tabs, or its text at estimated widths."""
    size = span["size"]
    wide = size * GLYPH_WIDTH
    if "chars" in span:
        for glyph in span["chars"]:
            sign, (x, y) = glyph["c"], glyph["origin"][:2]
            if sign and sign not in "\n\r\t":
                right = glyph["bbox"][2] if "bbox" in glyph else x + wide
                yield round(y, 1), round(x, 1), " " if sign.isspace() else sign, size, round(right, 1)
        return
    x, y = span["origin"]
    for place, sign in enumerate(span["text"]):
        yield round(y, 1), round(x + place * wide, 1), sign, size, round(x + (place + 1) * wide, 1)


def joined_glyphs(glyphs: Iterable[Glyph], box: Box | None = None) -> str:
    """Text of glyphs in reading order.

    A gap and a new line part words, but a word that a box's right edge broke,
    so that it goes on at the left edge, is closed again unless a closing sign
    stands before the break.
    """
    out, line, right, before = "", None, None, 0.0
    for y, left, sign, size, end in sorted(glyphs, key=lambda g: g[:2]):
        if line is None:
            line, before = y, size
        if sign == " ":
            out += " " * (out[-1:] not in ("", " "))
            right = end
            continue
        if abs(y - line) > LINE_STEP * size:
            margin = max(CELL_EDGE[0] * size, CELL_EDGE[1] * (box[2] - box[0])) if box else 0.0
            broken = box and right is not None and right >= box[2] - margin and left <= box[0] + margin
            if out[-1:] not in ("", " ") and (not broken or out[-1] in CLOSING):
                out += " "
            line = y
        elif right is not None and left - right > WORD_GAP * before:
            out += " "
        out += sign
        right, before = end, size
    return out.lstrip()


def block_text(block: dict) -> tuple[str, float]:
    """A block's text and its largest size; a block without lines has neither."""
    spans = [s for line in block.get("lines", ()) for s in line["spans"]]
    largest = round(max((s["size"] for s in spans), default=0.0), 1)
    return joined_glyphs((g for s in spans for g in span_glyphs(s)), block.get("bbox")), largest


def joined_blocks(blocks: list[tuple[str, Box | None]]) -> str:
    """Texts of blocks in order, parted by spaces; a word that the edge of the column (of all boxes) broke is closed."""
    boxes = [box for _, box in blocks if box]
    left, right = (min(b[0] for b in boxes), max(b[2] for b in boxes)) if boxes else (0.0, 0.0)
    margin = COLUMN_EDGE * (right - left)
    out, before = "", None
    for place, (text, box) in enumerate(blocks):
        if place and out and text and not (out[-1].isspace() or text[0].isspace()):
            broken = before and box and right - left > NARROW and before[2] >= right - margin and box[0] <= left + margin
            if not broken or out[-1] in CLOSING or ITEM.match(text):
                out += " "
        out += text
        before = box
    return out
