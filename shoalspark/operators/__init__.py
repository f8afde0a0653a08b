"""Relational operators over pixel, band, matchup and segment tables."""
