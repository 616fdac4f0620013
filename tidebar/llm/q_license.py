"""Query op13: licence notices of every document."""

from __future__ import annotations

from . import licenses
from .registry import query
from .store import table


@query("op13_license_scan")
def op13(spark, sf_dir):
    return licenses.scanned(table(spark, sf_dir, "documents"))
