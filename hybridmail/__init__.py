"""Hybrid keyword and vector retrieval over mail-like collections, on Spark."""
