"""Imports every query module so that its queries are registered."""

from kotonoha.plans import evidence_queries, geometry_queries, lexicon_queries, lookup_queries, model_queries, result_queries, source_queries, text_queries  # noqa: F401
from kotonoha.plans.registry import ORACLES, QUERIES  # noqa: F401
