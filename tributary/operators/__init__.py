"""Analyses over a logs table."""
