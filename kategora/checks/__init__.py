"""Queries over the shared test tables and the SQL each must agree with."""
