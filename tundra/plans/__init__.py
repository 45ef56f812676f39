"""Helpers that shape plans: table access, checkpoints, shipping code to workers."""
