"""Operators for preparing training corpora.

Nothing else in the library imports this subpackage; ``__spark_entry__``
registers its queries only where it can be imported.
"""
