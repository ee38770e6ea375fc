"""Named queries of the library and the DuckDB SQL they are checked against."""

from __future__ import annotations

from inkwell.plans import chunks, cleaning, learning, retrieval

QUERIES = cleaning.QUERIES | retrieval.QUERIES | chunks.QUERIES | learning.QUERIES
ORACLE = cleaning.ORACLE | retrieval.ORACLE | chunks.ORACLE | learning.ORACLE
