"""Readers and writers: scenes, headers, flight lines, in-situ tables."""
