"""Training-data operators: cleaning, scoring, de-duplication, formatting, packing and archives.

Nothing else in the library imports this subpackage; its queries are in :mod:`latticeq.llm.queries`.
"""
