"""Profiles, projections of tables onto the domain, and the registered queries."""
