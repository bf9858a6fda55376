"""Readers and the normalizers that turn what they read into events."""
