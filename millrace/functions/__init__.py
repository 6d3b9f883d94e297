"""Typed scalar expressions."""
