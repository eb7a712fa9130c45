"""Training-data operators: deduplication, tokenising, scoring, packing, archives."""

from ._shared import clean_up

__all__ = ["clean_up"]
