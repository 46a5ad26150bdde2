"""Maintenance plans made of several operators."""
