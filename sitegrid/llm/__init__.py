"""Operators for preparing training text: one module per operator, and ``queries`` with the registered queries."""
