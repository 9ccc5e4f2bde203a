"""Registered queries of the library, and the SQL that checks them."""

from __future__ import annotations

from corpusloom.plans import desk, front, library, shelf, studio
from corpusloom.plans import queries as plans

QUERIES: dict = plans.QUERIES | library.QUERIES | studio.QUERIES | desk.QUERIES | shelf.QUERIES | front.QUERIES
ORACLE_SQL: dict[str, str] = plans.ORACLE_SQL | library.ORACLE_SQL | studio.SQL | desk.SQL | shelf.SQL | front.SQL
