"""Imports every query module, so that the registry is full."""

from suite import answers_q, bench_q, core, fact, hot, io_q, more, qual, space, text, train  # noqa: F401
from suite.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
