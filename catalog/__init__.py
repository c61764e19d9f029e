"""Registered queries on the test tables, each with its SQL twin."""

from catalog.registry import QUERIES, SQL

from catalog import arrays, audits, balancing, evaluation, inputs_outputs, jobs, labels, sampling, texts, upkeep  # noqa: E402,F401

__all__ = ["QUERIES", "SQL"]
