"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from mnemos.llm import fuse, language, leaks, mix, names, nearest, similar, terms

_PARTS = (nearest, fuse, terms, similar, names, leaks, mix, language)
QUERIES = {k: f for part in _PARTS for k, f in part.QUERIES.items()}
ORACLE = {k: q for part in _PARTS for k, q in part.ORACLE.items()}
