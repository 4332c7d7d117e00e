"""Registered queries over the test tables, with the SQL that restates them."""
