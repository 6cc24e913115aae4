"""All registered queries."""

from __future__ import annotations

from brindle.plans import batches, corpus, evaluation, files, scalars, streams, training
from brindle.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "batches", "corpus", "evaluation", "files", "scalars", "streams", "training"]
