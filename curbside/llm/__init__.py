"""Operators on text corpora and web pages, and the queries that apply them to whole tables."""
