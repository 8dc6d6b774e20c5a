"""Replay of day files as they arrive. Only stateless day columns are applied."""
