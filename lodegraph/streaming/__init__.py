"""Incremental and streaming maintenance."""
