"""Registered queries of the audit engine."""

from tessera.plans import audit, copies, evaluation, image_files, preparation  # noqa: F401  (they register their queries)
from tessera.plans.registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)
