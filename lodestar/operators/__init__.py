"""Operators over points and nodes."""
