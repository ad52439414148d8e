"""All queries of the ledger engine and the SQL of those that SQL can express."""

from __future__ import annotations

from . import building, captions, evaluation, generation, signals, sweeps, speech, reliability, curation, stem_ledgers, real_mixes

MODULES = (evaluation, captions, signals, generation, building, sweeps, speech, reliability, curation, stem_ledgers, real_mixes)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for m in MODULES for name, text in m.ORACLES.items()}
