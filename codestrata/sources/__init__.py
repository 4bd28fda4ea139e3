"""Readers of source trees, commit logs, API pages and manifests."""
