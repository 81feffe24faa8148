"""All queries of this package and their SQL."""

from strandline.llm import queries_records, queries_terms, queries_texts

_PARTS = (queries_terms, queries_records, queries_texts)
QUERIES = {k: v for m in _PARTS for k, v in m.QUERIES.items()}
SQL = {k: v for m in _PARTS for k, v in m.SQL.items()}
