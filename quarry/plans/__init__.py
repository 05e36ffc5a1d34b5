"""Whole retrieval plans."""
