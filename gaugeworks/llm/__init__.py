"""Training-data operators over documents, pages and embeddings.

Nothing else in the package imports this subpackage; it can be removed as a
whole.  Its queries are in :mod:`gaugeworks.llm.queries`.
"""
