"""Operators for preparing training corpora (documents, pages, embeddings).

Each module holds one operator with its own interface; ``queries`` holds the
thin registered queries. Nothing outside this subpackage imports it.
"""
