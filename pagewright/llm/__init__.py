"""Operators of a large-scale training-data pipeline.

Nothing else in the library imports this subpackage. Every operator has a
general interface in its own module; :mod:`pagewright.llm.queries` holds the
thin ``opN_<name>`` queries of the driver contract.
"""
