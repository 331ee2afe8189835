"""Readers and writers, and the adapter from the test tables to the catalogue."""
