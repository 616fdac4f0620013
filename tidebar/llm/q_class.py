"""Query op9: a quality score for every document."""

from __future__ import annotations

from . import classifier
from .registry import query
from .store import table


@query("op9_quality_classifier")
def op9(spark, sf_dir):
    return classifier.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
