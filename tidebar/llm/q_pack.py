"""Query op4: all documents packed into sequences of 1024 tokens."""

from __future__ import annotations

import public_tokenizers

from . import packing
from .registry import query
from .store import table


@query("op4_best_fit_packing")
def op4(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
