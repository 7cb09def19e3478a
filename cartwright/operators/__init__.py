"""Distributed operators the built-in set lacks: exact order statistics, exact cosine top-k."""
