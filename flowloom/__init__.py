"""Flowloom: network-routing analytics expressed as Spark DataFrame jobs."""
