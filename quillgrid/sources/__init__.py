"""Readers, file audits and writers."""
