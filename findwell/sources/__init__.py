"""Scans: notes, HTML, attachments, file catalogs, caches."""
