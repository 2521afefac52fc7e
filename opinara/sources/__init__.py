"""Readers, views, stored models and the shared state folder."""
