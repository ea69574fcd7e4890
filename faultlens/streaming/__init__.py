"""Incremental processing of newly arriving incidents."""
