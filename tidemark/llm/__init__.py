"""Operators for training-data pipelines, one module each, and their queries.

Nothing outside this subpackage imports it; ``queries`` holds what
``__spark_entry__`` registers.
"""
