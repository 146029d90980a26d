"""Every registered query of the library's own operators, with equivalent DuckDB SQL."""

from __future__ import annotations

from .oracles import ORACLE_SQL
from .queries import QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
