"""Streams of records, beyond the reference: landed files into a store, and a running last-write-wins view."""
