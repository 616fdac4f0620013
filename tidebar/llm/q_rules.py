"""Query op3: base counts of every document, and the verdict of base rules and line labelling."""

from __future__ import annotations

from . import quality_rules
from .registry import query
from .store import table


@query("op3_quality_rules")
def op3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality_rules.judged(docs, quality_rules.fit_chain(docs, table(spark, sf_dir, "labels")))
