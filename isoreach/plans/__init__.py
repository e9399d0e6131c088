"""Registered queries: domain operators over the shared test tables."""
