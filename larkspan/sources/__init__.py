"""Readers with fixed schemas, writers, and clients of models and services."""
