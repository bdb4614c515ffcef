"""Text rules as column expressions: cleaning, masking, escaping, rendering."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from docmill.settings import CLASSIFIERS, KEPT_LETTERS, NUMERIC_UNITS

SPACE = r"(?U)\s"

#: Patterns of personal data and keys, in the order they are masked, with their placeholders.
MASKS = (
    (r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b", "[EMAIL_MASKED]"),
    (r"\b(?:\+82[-.\s]?)?\(?0[1-9]\d{0,2}\)?[-.\s]?\d{3,4}[-.\s]?\d{4}\b", "[PHONE_MASKED]"),
    (r"\b\d{6}[-.\s]?[1-48]\d{6}\b", "[RRN_MASKED]"),
    (
        r"\b(?:AIzaSy[a-zA-Z0-9_\-]{33}|sk-ant-sid\d+-[a-zA-Z0-9_\-]{40,}|sk-ant-[a-zA-Z0-9_\-]{40,}|sk-[a-zA-Z0-9_\-]{32,})\b",
        "[API_KEY_MASKED]",
    ),
)
#: Fixed value: keys whose values are hidden whole.
SECRET_KEYS = r"(?i)key|token|secret|auth"
HIDDEN = "********"

#: Fixed value: markers of prompt injection.
INJECTION = r"(?i)(###|---+|\bSystem:|\bAssistant:|\bHuman:|\[INST\]|\[/INST\]|<\|system\|>|<\|user\|>)"

#: Fixed value: page numbers that stand alone on a line.
NOISE = (r"(?im)^\s*-\s*\d+\s*-\s*$",)

ANNOTATION = r"<[^>]*(개정|신설|삭제)[^>]*>"


def stripped(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def longest_first(units: tuple[str, ...]) -> tuple[str, ...]:
    """Each unit once, longer ones first, equals in their order."""
    return tuple(sorted(dict.fromkeys(units), key=len, reverse=True))


def rejoined_units(text: Column, doc_type: str = "legal", units: tuple[str, ...] = NUMERIC_UNITS) -> Column:
    """Numbers with the counter that follows them, unless more Hangul follows; legal texts only."""
    if doc_type != "legal":
        return text
    return F.regexp_replace(text, rf"(?U)(\d+)\s+({'|'.join(longest_first(units))})(?![가-힣])", "$1$2")


def clean_text(text: Column, doc_type: str = "legal") -> Column:
    """White space collapsed, legal numbering in order, empty brackets closed, amendment notes dropped."""
    text = rejoined_units(stripped(F.regexp_replace(text, rf"{SPACE}+", " ")), doc_type)
    if doc_type == "legal":
        for c in CLASSIFIERS:
            for pattern in (rf"(?U)제\s*{c}\s*(\d+)", rf"(?U)제\s*(\d+)\s*{c}"):
                text = F.regexp_replace(text, pattern, f"제$1{c}")
    text = F.regexp_replace(text, rf"\({SPACE}+\)", "()")
    return stripped(F.regexp_replace(text, rf"{SPACE}*{ANNOTATION}", ""))


def without_leading_annotation(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{ANNOTATION}{SPACE}*", "")


def without_noise(text: Column, patterns: tuple[str, ...] = NOISE) -> Column:
    """Noise lines emptied, runs of blank lines made one, ends stripped."""
    for p in patterns:
        text = F.regexp_replace(text, p, "")
    return stripped(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def escaped_injection(text: Column) -> Column:
    """Markers of prompt injection in square brackets."""
    return F.regexp_replace(text, INJECTION, "[$1]")


def escaped_xml(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def escaped_html(text: Column) -> Column:
    """escaped_xml() with both quotes."""
    return F.replace(F.replace(escaped_xml(text), F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#x27;"))


def sanitised(text: Column) -> Column:
    return escaped_xml(escaped_injection(text))


def masked(text: Column) -> Column:
    """Personal data and keys as placeholders."""
    for pattern, placeholder in MASKS:
        text = F.regexp_replace(text, pattern, placeholder)
    return text


def masked_map(entries: Column) -> Column:
    """Values under secret-sounding keys hidden, others masked."""
    return F.transform_values(entries, lambda k, v: F.when(F.rlike(k, F.lit(SECRET_KEYS)), F.lit(HIDDEN)).otherwise(masked(v)))


def token_estimate(text: Column, ratio: float) -> Column:
    """Characters over ratio, rounded down, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / ratio).cast("int"))


def golden_norm(text: Column, more: str = "") -> Column:
    """A cell for comparison: without white space, brackets, dashes, dots and commas, and the words in more."""
    bare = F.regexp_replace(text, r"(?U)[\s()\-·‧,]", "")
    return F.replace(bare, F.lit(more), F.lit("")) if more else bare


def file_size(size: Column) -> Column:
    """A number of bytes in the largest unit of 1024 that fits, two digits."""
    units = F.array(*(F.lit(u) for u in ("B", "KB", "MB", "GB", "TB")))
    power = F.when(size > 0, F.least(F.lit(4), F.floor(F.log2(size.cast("double")) / 10).cast("int"))).otherwise(0)
    return F.concat(F.round(size / F.pow(F.lit(1024.0), power), 2).cast("string"), F.lit(" "), F.get(units, power))


def header_path(headers: list[Column], default: str = "기본 섹션") -> Column:
    """The headers above a text, joined; default if none."""
    joined = F.concat_ws(" > ", *headers)
    return F.when(joined == "", default).otherwise(joined)


def fenced_json(text: Column) -> Column:
    """The body of a json fence, or the whole text."""
    body = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    return F.when(body != "", body).otherwise(stripped(text))


def nfc(text: Column, form: str = "NFC") -> Column:
    """The Unicode normal form; Spark has no function for it."""

    def normal(values: pd.Series) -> pd.Series:
        return values.map(lambda v: v if v is None or v.isascii() else unicodedata.normalize(form, v))

    return F.pandas_udf(normal, StringType())(text)


def nfc_path(path: Column) -> Column:
    return nfc(F.replace(path, F.lit("\\"), F.lit("/")))


#: White space as Java's (?U)\s has it, and the same as signs to strip.
BLANK = r"[^\S\x1c-\x1f]"
BLANKS = "".join(c for c in map(chr, range(0x3001)) if re.match(BLANK, c))
#: Gaps in table cells with what stands before: between digits, between lone signs, after a counted number.
WORD_SIGNS = "가-힣A-Za-z0-9"
GAPS = tuple(
    re.compile(p)
    for p in (
        rf"(\d){BLANK}+(?=\d)",
        rf"((?<![{WORD_SIGNS}])[{WORD_SIGNS}]) +(?=[{WORD_SIGNS}](?![{WORD_SIGNS}]))",
        rf"([0-9][가-힣]){BLANK}+(?=(?![{KEPT_LETTERS}])[가-힣](?![{WORD_SIGNS}]))",
    )
)
#: Words of Hangul with gaps between; a sign that keeps a lone syllable from the word after it, and from the word before.
HANGUL_WORDS = re.compile(rf"(?<![가-힣])[가-힣]++(?:{BLANK}++[가-힣]++)+")
HANGUL_GAP = re.compile(rf"({BLANK}+)")
HELD_BEFORE = re.compile(rf"[{WORD_SIGNS})]")
HELD_AFTER = re.compile(rf"[{WORD_SIGNS}]")
RULE_CELL = re.compile(":?-+:?")


def joined_syllables(found: re.Match[str]) -> str:
    """Words of Hangul with their lone syllables joined to longer words, as in rounds that go on until nothing changes.

    In a round each lone syllable right before a longer word joins it, then each one right after. So those between two
    longer words are halved, the later half being the larger, and those beside one longer word all go there. Kept letters,
    and syllables that touch other signs, stay lone and part what is on their sides.
    """
    parts = HANGUL_GAP.split(found[0])
    words, gaps = parts[::2], parts[1::2]
    loose = [len(w) == 1 and w not in KEPT_LETTERS for w in words]
    loose[0] &= not HELD_BEFORE.match(found.string[found.start() - 1 : found.start()])
    loose[-1] &= not HELD_AFTER.match(found.string, found.end())
    if not any(loose):
        return found[0]
    last = -1
    for place in range(len(words) + 1):
        if place < len(words) and loose[place]:
            continue
        n = place - last - 1
        after = last >= 0 and len(words[last]) > 1
        before = place < len(words) and len(words[place]) > 1
        backward = (n // 2 if before else n) if after else 0
        forward = n - backward if before else 0
        gaps[last : last + backward] = [""] * backward
        gaps[place - forward : place] = [""] * forward
        last = place
    return "".join(w + g for w, g in zip(words, [*gaps, ""], strict=True))


def cell_repaired(cell: str) -> str:
    """repaired_cell() of one text."""
    for gap in GAPS:
        cell = gap.sub(r"\1", cell)
    return cell if cell.isascii() else HANGUL_WORDS.sub(joined_syllables, cell)


def tables_repaired(text: str) -> str:
    """repaired_tables() of one text."""

    def inner(cell: str) -> str:
        bare = cell.strip(BLANKS)
        if not bare or RULE_CELL.fullmatch(bare):
            return cell
        return cell[: len(cell) - len(cell.lstrip(" "))] + cell_repaired(bare) + cell[len(cell.rstrip(" ")) :]

    lines = text.split("\n")
    for i, line in enumerate(lines):
        if "|" in line:
            first, *cells, last = line.split("|")
            lines[i] = "|".join([first, *map(inner, cells), last])
    return "\n".join(lines)


def by_text(text: Column, rule: Callable[[str], str]) -> Column:
    """rule on every text that isn't null."""

    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: v if v is None else rule(v))

    return F.pandas_udf(run, StringType())(text)


def repaired_cell(cell: Column) -> Column:
    """A table cell with the gaps that layout tore into numbers and words closed again, in one pass; Spark has no function for it."""
    return by_text(cell, cell_repaired)


def repaired_tables(text: Column) -> Column:
    """repaired_cell() on the inner cells of every line with pipes; rule and blank cells and the blanks around a cell stay."""
    return by_text(text, tables_repaired)
