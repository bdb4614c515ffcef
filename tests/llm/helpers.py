"""Small document tables with every awkward case."""

from __future__ import annotations

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"

ENGLISH = "the river runs past the old mill and the people of the town walk along its bank in the evening light"
GERMAN = "der fluss fliesst an der alten muehle vorbei und die leute der stadt gehen am abend am ufer entlang"


def documents(spark, texts, lang=None, source=None):
    rows = []
    for i, t in enumerate(texts):
        rows.append((i, t, lang[i] if lang else "en", source[i] if source else f"src{i % 3}", len(t or "")))
    return spark.createDataFrame(rows, DOCUMENTS)


def awkward(spark):
    """Nulls in every column, empty and blank texts, a very long one, ties and repeated rows."""
    long_text = " ".join(f"{ENGLISH} {i}" for i in range(4000))
    rows = [
        (1, None, "en", "a", None),
        (2, "", None, None, 0),
        (3, " \t\n ", "en", "a", 4),
        (4, long_text, "en", "b", len(long_text)),
        (5, ENGLISH, "en", "a", 1),
        (5, ENGLISH, "en", "a", 1),
        (6, ENGLISH, "de", None, 1),
        (None, ENGLISH + " mill", None, "b", 1),
        (7, "12345 !!", "en", "c", 8),
        (8, "word", "en", "c", 4),
        (9, GERMAN, "de", "c", 4),
    ]
    return spark.createDataFrame(rows, DOCUMENTS)


def clashing(docs):
    """docs with columns named like those that operators make."""
    from pyspark.sql import functions as F

    names = ("fp", "component_id", "spans", "kept", "size", "taken", "target", "row_key", "host", "score", "lang_pred", "counts", "id", "tie", "words", "hash", "code", "failed")
    return docs.select("*", *(F.lit(i).alias(n) for i, n in enumerate(names)))
