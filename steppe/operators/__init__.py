"""Operators over tables of documents."""
