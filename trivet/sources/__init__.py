"""Readers and writers. All paths go through Spark, so they may be in any store."""
