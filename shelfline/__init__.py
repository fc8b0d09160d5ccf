"""Retail inventory and marketing analytics as plain PySpark DataFrame functions."""
