"""Incremental maintenance of pooled counts."""
