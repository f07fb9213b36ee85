"""Operators for large training-text corpora.

Nothing outside this subpackage imports it; ``queries.py`` lists the queries
that apply the operators to the tables, with their SQL where there is one.
"""
