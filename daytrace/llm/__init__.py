"""Operators of a training-data pipeline: filters, de-duplication, tokens, shards and archives.

Each module holds one operator with its own general interface; `queries` applies them to the
driver's tables. Nothing else in the library imports this subpackage.
"""
