"""Streams into a store, and quotas over streams."""
