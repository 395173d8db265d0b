"""Readers and writers of record blocks, text tables, sky maps and configuration."""
