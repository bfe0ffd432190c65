"""Names and places of results: marked names, no overwriting, publishing in one step, rendered text."""

from __future__ import annotations

import contextlib
import os
import re
import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Marks in file names; the last is an older one, only read.
MASKED, ANSWER, RESTORED, LEGACY = "[ANON]", "[ОТВЕТ]", "[RESTORED]", "[DEANON]"
_MARKS = r"\s*\[(?:ANON|ОТВЕТ|RESTORED|DEANON)\]\s*"


def stripped(stem: Column) -> Column:
    """A file's stem without any marks, wherever they stand."""
    return F.trim(F.regexp_replace(stem, "(?iu)" + _MARKS, " "))


def marked_name(stem: Column, mark: str, ext: str) -> Column:
    return F.concat(F.lit(mark + " "), stripped(stem), F.lit(ext))


def stripped_name(stem: str) -> str:
    return re.sub(_MARKS, " ", stem, flags=re.I).strip()


def free_path(folder: str, stem: str, ext: str) -> str:
    """A path that doesn't exist yet: with (2), (3)... up to (9999) behind the stem."""
    for k in range(1, 10_000):
        path = os.path.join(folder, f"{stem}{f' ({k})' if k > 1 else ''}{ext}")
        if not os.path.lexists(path):
            return path
    raise FileExistsError(f"{stem}{ext}")


@contextlib.contextmanager
def published(path: str):
    """A temporary file in the same folder that takes the name in one step, or disappears if anything fails."""
    handle, temporary = tempfile.mkstemp(prefix=".", dir=os.path.dirname(path) or ".")
    try:
        with os.fdopen(handle, "wb") as f:
            yield f
            f.flush()
            os.fsync(f.fileno())
        os.replace(temporary, path)
    except BaseException:
        with contextlib.suppress(FileNotFoundError):
            os.unlink(temporary)
        raise


def whole_text(segments: DataFrame, between: str = "") -> DataFrame:
    """doc_id, text: the segments of each document in their order. The rows of one document meet, no more."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seg_no", "text"))), lambda s: s["text"])
    return segments.groupBy("doc_id").agg(F.array_join(ordered, between).alias("text"))


def write_parquet(df: DataFrame, path: str) -> None:
    """Never over an existing result. Label tables need ``write_labels``."""
    if "value" in df.columns and "label" in df.columns:
        raise PermissionError("a label table holds the sensitive values; use write_labels to write it all the same")
    df.write.mode("errorifexists").parquet(path)


def write_labels(labels: DataFrame, path: str) -> None:
    labels.write.mode("errorifexists").parquet(path)
