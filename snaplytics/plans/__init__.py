"""Whole jobs: result tables from sources, in dependency order."""
