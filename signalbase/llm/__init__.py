"""Operators for preparing language-model training corpora.

Self-contained: nothing else in the library imports this subpackage, and it can
be removed together with ``tests/llm`` and ``corpus_pipeline.py``.
"""
