"""Whole programs as plans, and the registered queries with their SQL."""
