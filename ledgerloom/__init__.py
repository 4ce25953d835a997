"""Payload and evidence analytics on Spark."""
