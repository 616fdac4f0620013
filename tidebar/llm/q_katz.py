"""Query op5: log probability of every document under a Katz backoff model of the training documents."""

from __future__ import annotations

from . import katz
from .registry import query
from .store import table


@query("op5_katz_scoring")
def op5(spark, sf_dir):
    return katz.scored(table(spark, sf_dir, "documents"))
