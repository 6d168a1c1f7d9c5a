"""Corpus pipeline: toxic documents go, near duplicates go, benchmark passages go, personal data is masked, the rest is
packed into training sequences. Each stage's result is written as Parquet and read again by the next."""

from quantloom.llm.pipeline import ORACLE_SQL, STAGES, keep_civil, keep_distinct, keep_unleaked, mask_personal, pack_sequences, run

__all__ = ["ORACLE_SQL", "STAGES", "keep_civil", "keep_distinct", "keep_unleaked", "mask_personal", "pack_sequences", "run"]
