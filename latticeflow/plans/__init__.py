"""Registered queries over the test tables, each with the SQL that it is compared with."""
