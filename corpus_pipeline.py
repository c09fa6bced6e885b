"""The corpus pipeline: toxicity, line dedup, near-dedup, decontamination, tokens."""

from citesift.llm.stages import STAGES, run

# The classifier and MinHash have no SQL form; tests/llm compares with a brute-force version.
ORACLE_SQL = None

__all__ = ["ORACLE_SQL", "STAGES", "run"]
