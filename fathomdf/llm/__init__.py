"""Operators for building training corpora: ten components over documents, vectors and pages.

Nothing else in the library imports this subpackage. Each module holds one operator with its own general interface;
``queries`` holds the thin contract queries and their SQL.
"""
