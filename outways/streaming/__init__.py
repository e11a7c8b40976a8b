"""Freshness of feeds as a stream of observations."""
