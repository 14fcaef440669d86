"""Small helpers for oracle SQL text."""

from __future__ import annotations


def sql_list(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)
