"""Registered queries: operators bound to the driver tables, with SQL that says the same."""
