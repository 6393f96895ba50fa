"""What __spark_entry__ adds: the ten operators' queries and the pipeline."""

from __future__ import annotations

import corpus_pipeline

from .queries import ORACLES
from .queries import QUERIES as _OPERATORS

QUERIES = {**_OPERATORS, "pipeline": corpus_pipeline.run}
if corpus_pipeline.ORACLE_SQL:
    ORACLES = {**ORACLES, "pipeline": corpus_pipeline.ORACLE_SQL}

__all__ = ["ORACLES", "QUERIES"]
