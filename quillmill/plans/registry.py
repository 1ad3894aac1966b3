"""Queries over the driver's tables and the SQL that gives the same rows."""

from . import queries_documents, queries_files, queries_text

QUERIES: dict = queries_text.QUERIES | queries_documents.QUERIES | queries_files.QUERIES
ORACLE_SQL: dict[str, str] = queries_text.ORACLE_SQL | queries_documents.ORACLE_SQL | queries_files.ORACLE_SQL
