"""Registered queries over the given tables, each with its SQL where SQL can say it."""

from . import catalogs, chats, files, generation, records, sampling, streams  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
