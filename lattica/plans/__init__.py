"""Registered queries: the engine's operators over the driver's tables, each with the SQL that it must agree with."""

from __future__ import annotations

from .observations import ORACLES as _A
from .observations import QUERIES as _B
from .panels import ORACLES as _E
from .panels import QUERIES as _F
from .similarity import ORACLES as _C
from .similarity import QUERIES as _D
from .similarity import flagship

QUERIES = {**_D, **_B, **_F}
ORACLE_SQL = {**_C, **_A, **_E}

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]
