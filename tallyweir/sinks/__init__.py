"""Writes: versioned overwrite, append, and the one-pass valid/quarantine write."""
