"""Every query of the measurement engine, and its SQL."""

from . import accounts, associations, evaluation, export, history, reading, relational, scalars, scans, tables

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for module in (history, relational, accounts, evaluation, scalars, export, scans, associations, reading, tables):
    QUERIES |= module.QUERIES
    ORACLES |= module.ORACLES
