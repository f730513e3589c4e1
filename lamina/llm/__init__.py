"""Operators for preparing language-model training corpora.

Nothing outside this folder imports it; see ``queries.py`` for the registered queries.
"""
