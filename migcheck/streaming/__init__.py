"""Structured Streaming counterparts of the monitors."""
