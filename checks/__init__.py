"""Queries over the driver tables: each pairs a library call with an independent SQL statement."""
