"""Subtitle and transcript corpora as DataFrame operators keyed by media item."""
