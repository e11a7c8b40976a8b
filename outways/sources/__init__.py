"""Readers of timetables, road graphs, places and pages."""
