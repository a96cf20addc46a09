"""Registered queries: operators over the bound tables, each with the SQL that checks it."""
