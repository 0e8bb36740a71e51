"""Operators over sound-event tables; each takes and returns DataFrames."""
