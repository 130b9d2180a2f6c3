"""Operators for preparing training corpora at scale.

Nothing else in the library imports this subpackage; ``queries.py`` lists the
registered queries and is added by ``__spark_entry__`` when it can be imported.
"""
