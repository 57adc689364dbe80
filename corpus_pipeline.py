"""The corpus pipeline: language ID, exact dedup, near dedup, mixing and packing, one after another.

STAGES lists (name, function); run(spark, sf_dir) applies them to documents.
"""

from topicweave.llm.stages import ORACLE_SQL, STAGES, drop_copies, drop_near_copies, identify_language, mix_sources, pack_sequences, run

__all__ = ["ORACLE_SQL", "STAGES", "drop_copies", "drop_near_copies", "identify_language", "mix_sources", "pack_sequences", "run"]
