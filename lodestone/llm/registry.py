"""The queries of this subpackage and their SQL."""

from lodestone.llm import canonical, identifiers, leaks, mixing, neighbours, terms, variants

_ALL = (variants, neighbours, canonical, terms, leaks, mixing, identifiers)
QUERIES = {name: f for m in _ALL for name, f in m.QUERIES.items()}
SQL = {name: sql for m in _ALL for name, sql in m.SQL.items()}
