"""Operators over any tables: columns are named by the caller, sessions are partition keys, order is explicit."""
