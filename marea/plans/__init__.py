"""Registered queries with the SQL they are held against."""
