"""The corpus operators' queries and SQL twins."""

from __future__ import annotations

from docmill.llm import decontamination, language, language_model, licences, mixing, pseudonyms, quality, repeats, simhash, tokens

MODULES = (simhash, licences, tokens, quality, decontamination, pseudonyms, mixing, language_model, repeats, language)

QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLE = {name: sql for m in MODULES for name, sql in getattr(m, "ORACLE", {}).items()}
