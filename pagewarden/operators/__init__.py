"""Operators over page, robots, sitemap, vitals and finding tables."""
