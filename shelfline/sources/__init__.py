"""Readers, writers and the retail model over the given tables."""
