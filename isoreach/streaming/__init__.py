"""Feeds that arrive over time (beyond batch parity)."""
