"""All registered queries of the core and their SQL."""

from . import records, structure, tables

QUERIES = structure.QUERIES | tables.QUERIES | records.QUERIES
ORACLE_SQL = structure.ORACLE_SQL | tables.ORACLE_SQL | records.ORACLE_SQL
