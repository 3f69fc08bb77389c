"""The corpus pipeline of the training-data operators, for the driver: STAGES, run and ORACLE_SQL."""

from weftline.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
