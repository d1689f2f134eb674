"""Analyses that put the operators together."""
