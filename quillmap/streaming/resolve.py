"""Resolving a stream of documents: a plan without state, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quillmap.plans.resolve import Options, resolve


def resolve_stream(tokens: DataFrame, fields: DataFrame, path: str, checkpoint: str, options: Options = Options(), **trigger) -> StreamingQuery:
    """Writes the results of every batch of documents below ``path``, a folder per batch.

    ``fields`` is a stream of (doc_id, field, value, kind, context, page_hint) of
    documents whose tokens are in the table ``tokens``. Documents don't meet, so
    no state is kept; a batch that is run again overwrites its own folder.
    """

    def run(batch: DataFrame, number: int) -> None:
        own = tokens.join(batch.select("doc_id").distinct(), "doc_id", "left_semi")
        resolve(own, batch, options).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return fields.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
