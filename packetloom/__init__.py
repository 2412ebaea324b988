"""Packet-observation analytics on Spark: frames, events, conversations, streams."""

__version__ = "0.1.0"
