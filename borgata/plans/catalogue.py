"""All registered queries."""

from borgata.plans import (  # noqa: F401
    cleaning, enrichment, exchange, extraction, learning, parsing, search, statistics, storage, streams,
)
from borgata.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
