"""All named queries; importing this module fills the registry."""

from . import queries_checks, queries_files, queries_items, queries_layout, queries_pairs, queries_report, queries_state, queries_text  # noqa: F401
from .catalogue import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
