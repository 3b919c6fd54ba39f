"""Readers for the raw releases and writers for the results."""
