"""Streams of documents. Numbers and spreading terms need whole documents, so a row is a document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from maskloom.functions.tagging import Options
from maskloom.operators.masking import anonymize


def masked_stream(documents: DataFrame, path: str, checkpoint: str, options: Options | None = None, **trigger) -> StreamingQuery:
    """Mask documents as they come, into a folder for each batch below ``path`` (column ``batch``); a batch that runs again
    replaces its own folder, so each document is there once. Labels are not written."""

    def write(batch: DataFrame, number: int) -> None:
        anonymize(batch, options).select("doc_id", "text", "n_spans").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
