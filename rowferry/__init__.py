"""Table copies, bounded queries, a data dictionary and access rules on Spark.

The modules are imported by name, so that a worker loads only what its task uses.
"""
