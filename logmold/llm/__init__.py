"""Operators for preparing large text corpora (training-data pipelines).

Nothing else in the package imports this subpackage. Every operator takes and
returns DataFrames; the ``opN_*`` queries in :mod:`logmold.llm.queries` bind
them to the tables of a data folder.
"""
