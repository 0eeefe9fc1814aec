"""Reusable plan shapes: two-level ordered scans, exact ranks and quantiles, range joins.

They exist because a plain ``Window.partitionBy(entity)`` puts a whole entity in one task. When one
entity holds a large share of the rows that task never ends. Each shape here cuts a key into buckets
of its own order, works inside buckets, and carries only one summary row per bucket across them.
"""
