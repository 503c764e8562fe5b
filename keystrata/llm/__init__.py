"""Training-data operators: scoring, cleaning, joining, sharding and formatting of text corpora.

Nothing outside this subpackage imports it.
"""
