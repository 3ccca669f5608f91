"""Registered queries: an operator applied to the market tables, with its SQL twin."""
