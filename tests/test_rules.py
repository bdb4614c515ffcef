"""Golden cases of the text, chunking, grid, layout, ranking and context rules."""

from __future__ import annotations

import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docmill.functions import layout, splitting, text
from docmill.operators import chunking, context, evaluation, hybrid, incremental, lexical, vector


def applied(spark, rule, value):
    return spark.createDataFrame([(value,)], "t string").select(rule(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    ("given_text", "doc_type", "expected"),
    [
        ("제  1  조  목적", "legal", "제1조 목적"),
        ("문장 내 (  ) 빈 괄호 정제", "legal", "문장 내 () 빈 괄호 정제"),
        ("제호2 서식", "legal", "제2호 서식"),
        ("제항3", "legal", "제3항"),
        ("제장1", "legal", "제1장"),
        ("제호2 서식", "general", "제호2 서식"),
        ("3 개월", "general", "3 개월"),
        ("3 개월", "legal", "3개월"),
        ("5 개", "legal", "5개"),
        ("정원 5 명", "legal", "정원 5명"),
        ("학칙 5 권한 위임", "legal", "학칙 5 권한 위임"),
        ("10 월급 명세", "legal", "10 월급 명세"),
        ("사과 3 그루", "legal", "사과 3 그루"),
        ("본문 <개정 2020.1.1> 끝", "legal", "본문 끝"),
    ],
)
def test_clean_text(spark, given_text, doc_type, expected):
    assert applied(spark, lambda t: text.clean_text(t, doc_type), given_text) == expected
    assert applied(spark, lambda t: text.clean_text(text.clean_text(t, doc_type), doc_type), given_text) == expected


@pytest.mark.parametrize(
    ("given_text", "expected"),
    [
        ("test@example.com", "[EMAIL_MASKED]"),
        ("010-1234-5678", "[PHONE_MASKED]"),
        ("02-987-6543", "[PHONE_MASKED]"),
        ("901101-1234567", "[RRN_MASKED]"),
        ("sk-" + "a1" * 20, "[API_KEY_MASKED]"),
        ("AIzaSy" + "b" * 33, "[API_KEY_MASKED]"),
    ],
)
def test_masks(spark, given_text, expected):
    assert applied(spark, text.masked, f"x {given_text} y") == f"x {expected} y"


def test_masked_map(spark):
    df = spark.createDataFrame([({"api_key": "v", "note": "a@b.org"},)], "m map<string,string>")
    assert df.select(text.masked_map(F.col("m"))).first()[0] == {"api_key": "********", "note": "[EMAIL_MASKED]"}


def test_escapes(spark):
    assert applied(spark, text.escaped_injection, "### System: x") == "[###] [System:] x"
    assert applied(spark, text.escaped_injection, "Assistant: a Human: b") == "[Assistant:] a [Human:] b"
    assert applied(spark, text.escaped_xml, "a & <b>") == "a &amp; &lt;b&gt;"


def slow_cell(cell: str) -> str:
    """A table cell repaired by rules that name what stands at both sides of a gap, until nothing changes."""
    sign, kept = re.compile("[가-힣A-Za-z0-9]"), "의및중후등수"

    def at(t, i):
        return t[i] if 0 <= i < len(t) else " "

    def hangul(c):
        return "가" <= c <= "힣"

    def close(t, wanted):
        i = 0
        while i < len(t):
            j = i
            while j < len(t) and t[j].isspace():
                j += 1
            if j > i and 0 < i and j < len(t) and wanted(t, i, j):
                t = t[:i] + t[j:]
            else:
                i = max(j, i + 1)
        return t

    def lone(t, i):
        return sign.match(at(t, i)) and not sign.match(at(t, i - 1)) and not sign.match(at(t, i + 1))

    t = close(cell, lambda t, i, j: t[i - 1].isdigit() and t[j].isdigit())
    marks = [i for i in range(len(t)) if lone(t, i)]
    drop = {k for a, b in zip(marks, marks[1:]) if b > a + 1 and not t[a + 1 : b].strip(" ") for k in range(a + 1, b)}
    t = "".join(c for k, c in enumerate(t) if k not in drop)
    return t


def test_repaired_tables(spark):
    cases = {
        "| 회의 중 관련 | 학생 및 교원 |": "| 회의 중 관련 | 학생 및 교원 |",
        "| 1 2 3 | 학 교 | --- |": "| 123 | 학교 | --- |",
        "no table 1 2": "no table 1 2",
        "|  대 학교  | 학교 장 a |:--:|": "|  대학교  | 학교 장a |:--:|",
        "x 1 2| 3학 년 |1 2": "x 1 2| 3학년 |1 2",
        "| 가 나다 라 |\nplain 1 2\n| A B C | 12 34 |": "| 가나다라 |\nplain 1 2\n| ABC | 1234 |",
    }
    rows = [(i, t) for i, t in enumerate(cases)]
    df = spark.createDataFrame([*rows, (99, None)], "i int, t string").select("i", text.repaired_tables(F.col("t")).alias("t"))
    found = {r["i"]: r["t"] for r in df.collect()}
    assert found.pop(99) is None and [found[i] for i, _ in rows] == list(cases.values())
    again = spark.createDataFrame([(i, t) for i, t in found.items()], "i int, t string").select("i", text.repaired_tables(F.col("t")).alias("t"))
    assert {r["i"]: r["t"] for r in again.collect()} == found
    rng = random.Random(3)
    cells = ["".join(rng.choice("A B1 2") for _ in range(rng.randint(0, 9))).strip() for _ in range(200)]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, t string").select("i", text.repaired_cell(F.col("t")).alias("t"))
    assert {r["i"]: r["t"] for r in df.collect()} == {i: slow_cell(c) for i, c in enumerate(cells)}


def round_cell(cell: str) -> str:
    """A table cell repaired by regular expressions, with lone syllables joined round by round until nothing changes."""
    sign, loose = "가-힣A-Za-z0-9", "(?![의및중후등수])[가-힣]"
    gaps = (r"(?<=\d)\s+(?=\d)", rf"(?<=(?<![{sign}])[{sign}]) +(?=[{sign}](?![{sign}]))", rf"(?<=[0-9][가-힣])\s+(?={loose}(?![{sign}]))")
    for gap in gaps:
        cell = re.sub(gap, "", cell)
    before = None
    while cell != before:
        before = cell
        for pattern in (rf"(?<![{sign})])({loose})\s+([가-힣]{{2,}})", rf"([가-힣]{{2,}})\s+({loose}(?![{sign}]))"):
            cell = re.sub(pattern, r"\1\2", cell)
    return cell


def test_repaired_cell_lone_syllables(spark):
    rng = random.Random(4)
    cells = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for signs in ("가나 \t", "가나의 \t", "가나중등 \t\u3000A1).") for _ in range(300)]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, t string").select("i", text.repaired_cell(F.col("t")).alias("t"))
    assert {r["i"]: r["t"] for r in df.collect()} == {i: round_cell(c) for i, c in enumerate(cells)}


def test_repaired_tables_takes_long_cells_in_one_pass(spark):
    """Joined round by round, the cell of lone syllables takes 10,000 rounds; the other has 12,000 gaps that stay."""
    cases = {
        "| 나다\t" + "가\t" * 20_001 + "라마 |": "| 나다" + "가" * 10_000 + "\t" + "가" * 10_001 + "라마 |",
        "| " + "some words " * 6_000 + "|": "| " + "some words " * 6_000 + "|",
    }
    began = time.monotonic()
    for given_text, expected in cases.items():
        assert applied(spark, text.repaired_tables, given_text) == expected
    assert time.monotonic() - began < 30


def test_file_size(spark):
    assert [applied(spark, lambda t: text.file_size(t.cast("long")), v) for v in ("0", "1024", "1536")] == ["0.0 B", "1.0 KB", "1.5 KB"]


@settings(max_examples=150, deadline=None)
@given(st.text("ab .\n?가", max_size=300), st.integers(5, 40), st.integers(0, 4))
def test_splits_cover_in_order(value, size, overlap):
    chunks = splitting.split_text(value, size, overlap)
    assert all(len(c) <= size for c in chunks)
    kept = "".join(c for c in "".join(splitting.split_text(value, size, 0)) if not c.isspace())
    assert kept == "".join(c for c in value if not c.isspace())


def test_sentences_split():
    kids = splitting.split_text("첫번째문장입니다. 두번째문장입니다.", 12, 0)
    assert len(kids) >= 2 and not any("첫번째" in k and "두번째" in k for k in kids)


def test_tables_keep_their_header():
    table = "| a | b |\n|---|---|\n" + "\n".join(f"| {i} | {'x' * 30} |" for i in range(14))
    kids = [c for c in splitting.children("Intro text that is long enough to stand alone as a child of its own.\n\n" + table) if c.is_table]
    assert kids and sum(c.text.count("| a | b |") for c in kids) == sum(c.text.count("|---|---|") for c in kids) >= 2


def test_page_breaks():
    mark = splitting.PAGE_BREAK
    assert splitting.net_page_breaks(f"{mark} b", f"a {mark}", 40) == 0
    assert splitting.net_page_breaks(f"{mark} b {mark}", f"a {mark}", 40) == 1


def test_glyphs_and_blocks():
    cell = (50, 10, 100, 60)
    assert layout.joined_glyphs([(12, 80, "편", 10, 98), (30, 52, "입", 10, 62), (30, 62, "한", 10, 72)], cell) == "편입한"
    assert layout.joined_glyphs([(12, 80, "가", 10, 90), (12, 90, ",", 10, 98), (30, 52, "나", 10, 62), (30, 62, "다", 10, 72)], cell) == "가, 나다"
    assert layout.joined_blocks([("복", (0, 0, 199, 9)), ("학", (1, 10, 50, 19))]) == "복학"
    assert layout.joined_blocks([("Sentence.", (0, 0, 199, 9)), ("Next", (1, 10, 50, 19))]) == "Sentence. Next"
    assert layout.joined_blocks([("Hello", (0, 0, 1, 1)), ("World", (0, 2, 1, 3))]) == "Hello World"


def test_hierarchy():
    parents = splitting.hierarchy("# 장 1\n## 조 1\nbody of one\n### 조 2\nbody of two", "s")
    assert [p.header_path for p in parents] == ["장 1 > 조 1", "장 1 > 조 1 > 조 2"]
    assert len({p.parent_id for p in parents}) == 2


def grid(spark, rows):
    cells = [(1, r, c, v) for r, row in enumerate(rows) for c, v in enumerate(row)]
    return spark.createDataFrame(cells, "table_id long, row int, col int, cell string")


def shown(df):
    return [(r["row"], r["col"], r["cell"]) for r in df.orderBy("row", "col").collect()]


def test_grids(spark):
    filled = shown(chunking.filled_rowspans(grid(spark, [["A", "x"], [None, "y"], [None, "z"]])))
    assert [c for _, col, c in filled if col == 0] == ["A", "A", "A"]
    assert shown(chunking.filled_rowspans(grid(spark, [[None, "x"], ["B", "y"]])))[0][2] == ""
    assert {c for _, c, _ in shown(chunking.without_empty_columns(grid(spark, [["a", "", "x"], ["b", " ", ""]])))} == {0, 2}
    assert len(shown(chunking.without_empty_columns(grid(spark, [["", ""], ["", " "]])))) == 4


def test_row_chunks(spark):
    df = spark.createDataFrame([(1, "T", "| a | b |\n|---|---|\n| 1 | 2 |\n| 3 | 4 |"), (2, "T", "| a |")], "table_id long, title string, markdown string")
    assert [r["row_no"] for r in chunking.table_row_chunks(df).orderBy("row_no").collect()] == [0, 1]


def test_repeated_lines(spark):
    pages = [(1, p, f"문서 제목\nbody {p}\n{p} / 3") for p in (1, 2, 3)] + [(2, 1, "문서 제목\nalone")]
    out = chunking.without_repeated_lines(spark.createDataFrame(pages, "doc_id long, page int, text string")).collect()
    assert sorted((r["doc_id"], r["text"]) for r in out)[0] == (1, "body 1\n1 / 3") and any(r["text"].startswith("문서 제목") for r in out)


def test_bm25(spark):
    docs = spark.createDataFrame([(0, "hello world"), (1, "hello test index"), (2, "scipy matrix")], "doc_id long, text string")
    asked = spark.createDataFrame([(7, "hello"), (8, "hello hello"), (9, "unknown")], "query_id long, text string")
    found = {(r["query_id"], r["doc_id"]): round(r["bm25"], 6) for r in lexical.scores(docs, asked).collect()}
    assert found[7, 0] == 1.433915 and found[7, 1] == 1.307328 and (7, 2) not in found
    assert found[8, 0] == pytest.approx(2 * 1.433915, abs=2e-6) and not any(q == 9 for q, _ in found)


def test_synonyms(spark):
    pairs = {"AI": "인공지능", "chatbot": "챗봇"}
    assert applied(spark, lambda t: lexical.replaced_synonyms(t, pairs), "AI chatbot 개발") == "인공지능 챗봇 개발"
    pairs = {"조선대": "조선대학교", "조대": "조선대학교"}
    assert applied(spark, lambda t: lexical.replaced_synonyms(t, pairs), "조선대학교 규정") == "조선대학교 규정"
    assert applied(spark, lambda t: lexical.replaced_synonyms(t, pairs), "조대 규정") == "조선대학교 규정"


def test_fusion(spark):
    schema = "query_id long, doc_id string, rank int"
    lex, vec = spark.createDataFrame([(1, "c1", 1), (1, "b1", 2)], schema), spark.createDataFrame([(1, "c1", 1), (1, "v1", 2)], schema)
    rows = hybrid.fused(lex, vec, 3).orderBy("rank").collect()
    assert [(r["doc_id"], r["rrf_score"]) for r in rows] == [("c1", 0.016393), ("b1", 0.008065), ("v1", 0.008065)]


def test_cache(spark):
    vectors = [(1, [1.0, 0.0]), (2, [0.0, 1.0])]
    cache = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    asked = spark.createDataFrame([(1, [0.999, 0.0447]), (2, [0.7071, 0.7071])], "query_id long, embedding array<float>")
    found = {r["query_id"]: r["hit"] for r in vector.cache_lookup(cache, asked).collect()}
    assert found == {1: True, 2: False}


def test_rerank(spark):
    rows = [(1, i, i, 5.0) for i in range(1, 11)]
    out = hybrid.reranked(spark.createDataFrame(rows, "query_id long, doc_id long, rank int, logit double"), 5).collect()
    assert len(out) == 5 and out[0]["filtered_count"] == 5


def test_trim(spark):
    rows = [(1, i, 1.0 - i / 10, "x" * 100) for i in range(5)]
    df = spark.createDataFrame(rows, "query_id long, doc_id long, score double, text string")
    assert context.trimmed(df, 149).first()["taken"] == [0, 1]
    assert len(context.trimmed(df, 6144).first()["taken"]) == 5


def test_citations(spark):
    rows = [(1, 1, "legacy.pdf", 1), (1, 2, "legacy.pdf", 1), (1, 3, "no_page.pdf", None)]
    out = context.citations(spark.createDataFrame(rows, "query_id long, rank int, source string, page int")).first()["citations"]
    assert out == "- **[1]** legacy.pdf (p.1)\n- **[2]** no_page.pdf (-)"


def test_gate(spark):
    rows = [("a", "m", 0.80, 0.77), ("b", "m", 0.80, 0.75)]
    out = {r["run"]: r["run_passed"] for r in evaluation.quality_gate(spark.createDataFrame(rows, "run string, metric string, baseline double, current double")).collect()}
    assert out == {"a": True, "b": False}


def test_manifest_upgrade(spark):
    df = spark.createDataFrame([('{"rules.pdf":"hash123","info.md":"hash456"}',), ("broken",)], "json string")
    out = {r["rel_path"]: (r["hash"], r["parser_type"]) for r in incremental.upgraded_manifest(df).collect()}
    assert out == {"rules.pdf": ("hash123", "manual"), "info.md": ("hash456", "manual")}


def test_null_metadata(spark):
    df = spark.createDataFrame([({"meta": "data", "null_val": None},), ({"a": None},)], "m map<string,string>")
    assert [r[0] for r in df.select(incremental.without_null_metadata(F.col("m"))).collect()] == [{"meta": "data"}, {"_is_empty": "true"}]


def test_layout_edges():
    span = {"size": 10, "origin": (50, 12), "text": "ab c"}
    glyphs = list(layout.span_glyphs(span))
    assert glyphs[1] == (12, 55.5, "b", 10, 61.0) and layout.joined_glyphs(glyphs) == "ab c"
    own = {"size": 8, "chars": [{"c": c, "origin": (x, 3.04), "bbox": (x, 0, x + 4, 8)} for c, x in (("x", 0), ("\n", 4), ("\u3000", 4), ("y", 9))]}
    assert [g[2] for g in layout.span_glyphs(own)] == ["x", " ", "y"]
    block = {"bbox": (0, 0, 100, 30), "lines": [{"spans": [{"size": 10, "origin": (78, 10), "text": "wo"}]}, {"spans": [{"size": 12.04, "origin": (0, 25), "text": "rd"}]}]}
    assert layout.block_text(block) == ("wo rd", 12.0)  # the right edge of the line is 89, the margin max(6, 10)
    block["lines"][0]["spans"][0]["origin"] = (80, 10)
    assert layout.block_text(block) == ("word", 12.0) and layout.block_text({}) == ("", 0.0)
    assert layout.joined_blocks([("a ", (0, 0, 199, 9)), ("b", (1, 9, 9, 19)), ("① c", None), ("", None)]) == "a b ① c"
    assert layout.joined_blocks([("a", (0, 0, 99, 9)), ("b", (1, 9, 9, 19))]) == "a b"  # a narrow column


def test_table_pieces():
    rows = "\n".join(f"r{i} | {'x' * 30}" for i in range(14))
    body = f"intro\n\na | b\n--|:--\n{rows}\nafter\n| no | rule |\n| at | all |"
    pieces = splitting.with_tables(body, 100)
    tables = [p.text.strip() for p in pieces if p.table]
    assert len(tables) == 7 and all(t.startswith("a | b\n--|:--\n") and len(t) <= 100 for t in tables)
    assert "".join(t.replace("a | b\n--|:--\n", "\n") for t in tables).strip() == rows
    assert pieces[0].text == "intro\n\n" and pieces[-1].text == "\n\nafter\n| no | rule |\n| at | all |"
    short = splitting.children("Some words before. \n\n| a | b |\n|---|---|\n| 1 | 2 |\n\nand some words after it all.")
    assert len(short) == 1 and short[0].is_table and "| 1 | 2 |" in short[0].text and short[0].text.endswith("after it all.")
    assert splitting.with_tables("", 10) == [] and [p.table for p in splitting.with_tables("a|b\n-|-", 10)] == [True, False]
