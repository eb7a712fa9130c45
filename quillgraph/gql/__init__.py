"""The text query language."""

from .reader import parse, split_script

__all__ = ["parse", "split_script"]
