"""Typed readers, writers and the input schemas."""
