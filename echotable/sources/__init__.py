"""Readers, writers, and the sound-event view of the driver's tables."""
