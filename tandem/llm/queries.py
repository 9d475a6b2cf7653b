"""All queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from tandem.llm import queries_dedup, queries_quality, queries_secrets, queries_text, queries_tokens, queries_vectors, queries_web

_MODULES = (queries_dedup, queries_quality, queries_secrets, queries_text, queries_tokens, queries_vectors, queries_web)
QUERIES = {k: q for m in _MODULES for k, q in m.QUERIES.items()}
SQL = {k: q for m in _MODULES for k, q in m.SQL.items()}
