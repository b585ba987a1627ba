"""Operators for large training-data pipelines.

Nothing outside this subpackage imports it; ``tallyfold.llm.queries`` lists the
registered queries.
"""
