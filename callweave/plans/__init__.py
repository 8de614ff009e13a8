"""Registered queries. Importing the package fills the registry."""

from callweave.plans import documents, evaluation, phrases, text, topics, vectors  # noqa: F401
from callweave.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
