"""All queries of the core and their SQL."""

from strandline.plans import binaries, catalogued, catalogues, integrity, matching, streams

_PARTS = (integrity, matching, catalogues, binaries, catalogued, streams)
FLAGSHIP = "string_match_rank"
QUERIES = {k: v for m in _PARTS for k, v in m.QUERIES.items()}
SQL = {k: v for m in _PARTS for k, v in m.SQL.items()}
