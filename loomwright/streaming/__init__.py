"""Stateful and incremental processing."""
