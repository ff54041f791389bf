"""Retrieval, record and graph operators."""
