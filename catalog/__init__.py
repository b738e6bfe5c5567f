"""Registered queries over the sample tables, each with its check SQL."""
