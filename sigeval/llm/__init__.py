"""Operators for preparing language-model training corpora.

Nothing else in the library imports this package; it is registered only where
it is present. ``queries.QUERIES`` and ``queries.ORACLES`` list the registered
queries and their SQL."""
