"""Operators of a training-data pipeline over document and conversation tables.

Every module holds one operator with its own general interface; ``queries``
binds them to the test tables as ``opN_<name>``. Nothing outside this
subpackage imports it.
"""
