"""Readers, writers and static dimensions."""
