"""Registered queries over the supplied tables, and DuckDB SQL that gives the same rows."""

from . import alerts, archive, control, legislative, matching, parsing, registers, search, streams

_ALL = (legislative, archive, parsing, registers, matching, search, alerts, control, streams)
QUERIES = {name: query for module in _ALL for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _ALL for name, sql in module.ORACLES.items()}
