"""Statements, predicates over keys, and the ranges of key space that they leave."""
