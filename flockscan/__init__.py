"""Spark jobs for finding coordinated behaviour among social-media accounts."""
