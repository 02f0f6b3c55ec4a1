"""Column helpers: missing-value rules, ranks, column selection."""
