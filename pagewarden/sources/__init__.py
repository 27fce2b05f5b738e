"""Table scans and table writers."""
