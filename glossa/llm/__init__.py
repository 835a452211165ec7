"""Operators for preparing large text corpora for language-model training.

Nothing outside this folder imports it; ``queries.py`` lists the registered queries.
"""
