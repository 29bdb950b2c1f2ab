"""Every registered query; importing the query modules fills the registry."""

from dnslake.plans import queries_files, queries_life, queries_log, queries_names, queries_nets  # noqa: F401
from dnslake.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
