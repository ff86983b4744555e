"""The corpus pipeline, as its driver expects it; it lives in ``tempolith.llm.pipeline``."""

from tempolith.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
