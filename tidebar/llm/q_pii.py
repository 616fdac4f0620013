"""Query op6: personal data in every document."""

from __future__ import annotations

from . import pii
from .registry import query
from .store import table


@query("op6_pii")
def op6(spark, sf_dir):
    return pii.digests(table(spark, sf_dir, "documents"))
