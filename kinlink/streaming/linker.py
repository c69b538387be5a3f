"""An extra: linking a stream of other-source records against a fixed first source, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import blocking


def link_batch(ones: DataFrame, batch: DataFrame) -> DataFrame:
    """Candidate pairs of one batch with the first source, scored by shared keys and ranked. Frequencies are those of the batch and the first source together."""
    rec = ones.unionByName(batch)
    keys = blocking.keys(rec)
    pairs = blocking.candidate_pairs(keys, blocking.blocks(keys))
    return blocking.with_ranks(pairs, "nkeys")


def link_stream(ones: DataFrame, stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs link_batch on every micro-batch and hands the result to sink with the batch's number, which lets the sink write each batch once."""

    def each(batch: DataFrame, number: int) -> None:
        sink(link_batch(ones, batch), number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()
