"""Training-data operators: dedup, decontamination, filters, tokens, shards.

Nothing outside this subpackage imports it.  Every operator lives in a module
of its own with a general interface; :mod:`lodestar.llm.queries` registers the
thin queries that apply them to whole tables.
"""
