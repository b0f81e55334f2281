"""Peptides that arrive as a stream, searched against a stored index.

Each micro-batch is searched as a whole; the index is static, so there is no state, and a batch that is run
again overwrites its own output folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from peptrail.functions.config import SearchConfig
from peptrail.plans.engine import Index, search
from peptrail.sources.scratch import Scratch


def search_stream(peptides: DataFrame, index: Index, path: str, checkpoint: str, cfg: SearchConfig = SearchConfig()) -> StreamingQuery:
    """Write the alignments of each batch of a streaming DataFrame (query_id, peptide, precursor_mass) below path."""

    def run(batch: DataFrame, batch_id: int) -> None:
        scratch = Scratch(batch.sparkSession, "stream")
        try:
            search(index, batch, cfg, scratch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        finally:
            scratch.close()

    return peptides.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
