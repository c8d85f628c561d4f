"""All that the driver's entry module registers from this subpackage."""

from __future__ import annotations

import corpus_pipeline
from palisade.llm.oracle import ORACLE_SQL as OPERATOR_SQL
from palisade.llm.queries import QUERIES as OPERATOR_QUERIES

QUERIES = {**OPERATOR_QUERIES, "pipeline": corpus_pipeline.run}
ORACLE_SQL = {**OPERATOR_SQL, **({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})}

__all__ = ["ORACLE_SQL", "QUERIES"]
