"""Training-data operators: sharding, tokens, deduplication, quality and safety.

Nothing outside this package imports it. Modules whose functions run on
executors are pickled by value, so a cluster needs no copy of this package on
its workers.
"""
