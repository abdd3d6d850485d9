"""loomline: a Spark-native engine for resolving observation tracks into persistent identities.

Nothing in this package imports the ``llm`` subpackage; it can be removed without touching the rest.
"""
