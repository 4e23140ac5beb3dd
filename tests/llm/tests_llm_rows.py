"""Rows that the corpus tests share."""

from test_corpus_operators import DOCS, odd_rows, prose, table, with_extra  # noqa: F401
