"""Training-data operators over document tables, one module each.

Nothing else in the library imports this package. ``QUERIES`` and ``ORACLES``
are put together in ``tidemark.llm.catalog``.
"""
