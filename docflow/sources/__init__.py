"""Readers, writers and checks of incoming rows."""
