"""Training-data operators: mixing, near-dedup, packing, scans, search and classifiers.

Nothing outside this subpackage imports it.  ``loomtext.llm.registry`` lists the
queries and their SQL for the entry module.
"""
