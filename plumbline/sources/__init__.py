"""Scans: workspace files, syntax trees, clone reports, vector caches; and the text sink."""
