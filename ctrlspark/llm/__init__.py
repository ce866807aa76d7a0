"""Operators of a large-scale training-data pipeline.

Nothing else in the library imports this subpackage.  Operators live one to a
module and are re-exported by ``queries`` as registered queries.
"""
