"""Uploads and word tables."""
