"""Declared schemas: a small line language, its checks, and violations of data."""
