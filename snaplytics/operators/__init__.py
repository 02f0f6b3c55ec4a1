"""The reports' building blocks, each a function from tables to a table."""
