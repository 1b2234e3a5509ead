"""Readers, writers and the bar builders."""
