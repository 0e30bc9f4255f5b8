"""Whole jobs: analysis of many stacks, threshold sweeps, seeded runs."""
