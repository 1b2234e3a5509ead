"""Registered queries: operators applied to the given tables, and the SQL that states each."""
