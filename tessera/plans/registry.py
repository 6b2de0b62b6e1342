"""All registered queries of the library and their SQL."""

from __future__ import annotations

from tessera.plans import histories, histories_oracle, oracle, queries, streams, texts

QUERIES = queries.QUERIES | histories.QUERIES | texts.QUERIES | streams.QUERIES
ORACLE_SQL = oracle.SQL | histories_oracle.SQL | texts.SQL | streams.SQL
