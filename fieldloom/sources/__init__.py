"""Readers and writers: backup archives, state folders, page tables, books."""
