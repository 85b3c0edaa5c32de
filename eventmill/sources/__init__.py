"""Scans that turn raw documents into event rows."""
