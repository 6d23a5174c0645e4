"""Names of all queries of this library's own operators, with the SQL that gives the same rows."""

from __future__ import annotations

from sparkloom.plans import associations, decks, records, scalars, spaces, texts

QUERIES: dict = associations.QUERIES | records.QUERIES | spaces.QUERIES | scalars.QUERIES | decks.QUERIES | texts.QUERIES
SQL: dict[str, str] = associations.SQL | records.SQL | spaces.SQL | scalars.SQL | decks.SQL | texts.SQL
