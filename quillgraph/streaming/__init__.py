"""Streams of changes and their batch twins."""
