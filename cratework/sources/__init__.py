"""Scans: XML dumps, JSON pages and documents, stored snapshots, star-schema tables."""
