"""Stored tables, record files, JSON documents and web pages."""
