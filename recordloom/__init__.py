"""Versioned record analytics on Spark."""
