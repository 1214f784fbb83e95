"""Readers: driver tables as places, JSON, Markdown, partitioned scans."""
