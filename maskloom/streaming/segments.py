"""Streams of segments whose documents are spread over micro-batches.

Spans are found in columns; what a value's number is, is kept as state of its document, so a value has the same label
in whatever batch it comes again. Labels are rebuilt from the state, which lives in the checkpoint of the query: it
holds the sensitive values and must be guarded like the originals.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from maskloom.functions import native as N
from maskloom.functions import tagging as T

_ROWS = "doc_id long, seg_no long, text string, spans array<struct<start:int,stop:int,category:string,value:string>>, numbers array<int>"


def _number(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Numbers by first appearance: within a batch by seg_no, then by batch. The state is a map from category and value to number."""
    known: dict[str, dict[str, int]] = json.loads(state.get[0]) if state.exists else {}
    rows = pd.concat(list(batches)).sort_values("seg_no", kind="stable")
    numbers = []
    for spans in rows["spans"]:
        own = []
        for s in spans:
            values = known.setdefault(s["category"], {})
            own.append(values.setdefault(s["value"], len(values) + 1))
        numbers.append(own)
    state.update((json.dumps(known, ensure_ascii=False),))
    yield pd.DataFrame({"doc_id": rows["doc_id"], "seg_no": rows["seg_no"], "text": rows["text"], "spans": [list(s) for s in rows["spans"]], "numbers": numbers})


def masked_segments(segments: DataFrame, options: T.Options | None = None) -> DataFrame:
    """A stream of masked segments (doc_id, seg_no, text) from one of segments; a null text is an empty one.

    Every rule and the small recogniser apply to each segment; terms don't spread, since later segments aren't there yet.
    Numbers follow the order in which segments come, so three batches in order give the labels of one.
    """
    options = options or T.Options()
    rows = segments.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("seg_no").cast("long").alias("seg_no"), F.coalesce("text", F.lit("")).alias("text"))
    raw = F.concat(T.tagged_entities(T.entity_rows(F.col("text"), T.recognised(F.col("text")), options)), T.rule_spans(F.col("text"), options))
    found = rows.select("doc_id", "seg_no", "text", F.explode(F.array(raw)).alias("raw")).select("doc_id", "seg_no", "text", N.merged(F.col("raw"), F.col("text")).alias("spans"))
    numbered = found.groupBy("doc_id").applyInPandasWithState(_number, _ROWS, "known string", "append", GroupStateTimeout.NoTimeout)
    with_n = F.transform("spans", lambda s, i: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["category"].alias("category"), F.get("numbers", i).alias("n")))
    return numbered.select("doc_id", "seg_no", "text", with_n.alias("spans")).select("doc_id", "seg_no", N.spliced(F.col("text"), F.col("spans"), lambda s: N.label(s["category"], s["n"])).alias("text"))
