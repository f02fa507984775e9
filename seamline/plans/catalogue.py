"""All queries over the reference tables, with their DuckDB SQL."""

from __future__ import annotations

from seamline.plans import detection, exports, judging, labels, shapes, texts, verification

MODULES = (judging, shapes, texts, detection, labels, exports, verification)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL = {k: s for m in MODULES for k, s in m.ORACLE_SQL.items()}
