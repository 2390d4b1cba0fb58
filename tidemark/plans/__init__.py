"""Queries over the market tables and the SQL that another engine can check them with."""
