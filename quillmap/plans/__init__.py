"""Whole queries put together from operators."""
