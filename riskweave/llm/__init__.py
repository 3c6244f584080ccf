"""Operators that prepare a text corpus for language-model training.

Nothing else in the library imports this subpackage. Every operator takes and
returns DataFrames; `queries` applies them to the driver's tables.
"""
