"""Relational and graph operators over log data."""
