"""Readers and adapters that produce the tables the operators work on."""
