"""Registered queries, each with the SQL that gives the same rows."""
