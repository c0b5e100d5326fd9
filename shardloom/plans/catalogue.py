"""All registered queries with their SQL twins."""

from __future__ import annotations

from . import q_checks, q_more, q_reports, q_sampling, q_sources, q_ssl, q_trials, q_vectors  # noqa: F401  they register on import
from .registry import ORACLES, QUERIES


def flagship(spark, sf_dir: str):
    """Retrieval metrics of the embedding table."""
    return QUERIES["retrieval_metrics"](spark, sf_dir)


def queries() -> dict:
    return QUERIES


def oracles() -> dict[str, str]:
    return ORACLES
