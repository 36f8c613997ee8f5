"""Training-data operators: ten corpus operations run as Spark jobs.

Nothing outside this subpackage imports it; the registry of queries adds it
only when it is present.
"""
