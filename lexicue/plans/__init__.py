"""Registered jobs: operators applied to the given tables, each with its SQL twin where there is one."""

from lexicue.plans import documents, feed, intervals, learning, mutations, pages, pricing, segments, sequence, streaming, text, vocab  # noqa: F401
from lexicue.plans.registry import JOBS

__all__ = ["JOBS"]
