"""Keyed state: the same functions serve a batch replay and a stream."""
