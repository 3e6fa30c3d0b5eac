"""Operators for preparing large text corpora, one module each, and their registered queries."""
