"""Registered queries, their fixture views and their oracle SQL."""
