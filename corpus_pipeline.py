"""The training corpus pipeline, as its caller imports it."""

from matchloom.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
