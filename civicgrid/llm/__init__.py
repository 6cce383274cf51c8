"""Operators over text, pages and vectors for preparing training corpora. Nothing else in the package imports this one."""
