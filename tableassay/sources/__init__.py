"""Readers and writers; module functions are the primary API."""
