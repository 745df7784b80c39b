"""Loomlake: memory analytics and corpus preparation as plain Spark plans."""
