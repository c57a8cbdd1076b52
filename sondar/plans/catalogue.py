"""All queries of the core and their oracle SQL."""

from __future__ import annotations

from sondar.plans import datasets, evaluation, probing, registered, sequences, streamed, tokenized

_PARTS = (probing, evaluation, datasets, sequences, tokenized, registered, streamed)

QUERIES: dict = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLES: dict = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
