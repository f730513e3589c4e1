"""All registered queries; importing this module fills the registry."""

from __future__ import annotations

from lamina.plans import graph_queries, store_queries, text_queries, version_queries, xml_queries  # noqa: F401
from lamina.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
