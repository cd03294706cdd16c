"""Registered queries and their SQL."""

from . import catalog, files, functions, provenance, rules, streams, upkeep, uploads, versions, write  # noqa: F401  registers
from .registry import ORACLES, QUERIES  # noqa: F401
