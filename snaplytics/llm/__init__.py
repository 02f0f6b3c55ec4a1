"""Operators for preparing training text: filters, duplicate removal, mixing, token output, archives."""
