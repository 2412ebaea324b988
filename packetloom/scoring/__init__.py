"""Deterministic scoring of answers that cite frames."""
