"""Scans: tables, document files, generated frames and the demo data binding."""
