"""Registered queries and their SQL counterparts."""
