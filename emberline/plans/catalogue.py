"""All registered queries: importing the query modules fills the registry."""

from . import alignment, channelling, history, sampling, scoring, storage, windowing  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
