"""Micro-batches of a stream into a keyed table.

The engine has no streaming operators of its own; a sink is what a stream needs to feed a table.
"""
