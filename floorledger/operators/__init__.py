"""Reusable relational steps that the reports are composed of."""
