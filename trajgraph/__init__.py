"""Trajectory-to-graph analytics as DataFrame transformations."""
