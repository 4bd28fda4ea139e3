"""Measurements as DataFrame transformations; repo_id is a key in every table."""
