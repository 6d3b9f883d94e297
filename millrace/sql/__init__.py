"""The query language: grammar and syntax tree."""
