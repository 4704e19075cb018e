"""Text-corpus operators for training-data work.

Nothing else in the library imports this subpackage; its queries are collected in
``fleetlens.llm.queries``.
"""
