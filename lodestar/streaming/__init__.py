"""Nearest neighbours of a stream of queries."""
