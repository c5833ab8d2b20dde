"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it.  Each module holds one operator;
``queries`` binds them to the driver tables.
"""
