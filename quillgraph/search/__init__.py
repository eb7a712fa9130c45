"""Ranked search: lexical, vector, and both fused."""
