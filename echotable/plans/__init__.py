"""Registered queries of the sound-event library with their SQL twins."""

from __future__ import annotations

from echotable.plans import compare, dataset, files, live, serving

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (compare, serving, dataset, live, files):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
