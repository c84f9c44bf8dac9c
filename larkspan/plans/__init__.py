"""Whole plans: the note fixture, the registered queries with their SQL, and text reports."""
