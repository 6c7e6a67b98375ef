"""Queries of the engine's operators over the test tables, with the SQL that checks them."""
