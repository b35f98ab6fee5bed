"""Imports every catalog so that its queries are registered."""

from . import catalog_context, catalog_text, catalog_trace, catalog_usage  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
