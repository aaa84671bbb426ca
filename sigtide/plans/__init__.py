"""Whole dataflows: stages, served queries, and the derivation of domain tables."""
