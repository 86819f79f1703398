"""The queries of this subpackage and their DuckDB SQL, where SQL can express them."""

from importlib import import_module

MODULES = ["secrets", "spotsigs", "interpolation", "quotes", "mixing", "bytebpe", "shingles", "embeddings", "sharding", "toxicity"]

QUERIES = {}
SQL = {}
for _name in MODULES:
    _module = import_module(f"{__package__}.{_name}")
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
