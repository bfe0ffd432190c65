import subprocess
import sys
from pathlib import Path

import pytest

from maskloom.llm import quality as Q
from maskloom.llm import segmentation as S
from maskloom.llm import simhash as H
from maskloom.llm import tiling as T

#: A task whose small objects are freed below some that stay, so that the heap can't just shrink.
TASK = """
import re, sys
from pathlib import Path
from maskloom.llm.common import giving_back
stay = []
def held():
    return int(re.search(r"Anonymous:\\s+(\\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) // 1024
def run(batches):
    for b in batches:
        made = [bytes(2000) for _ in range(b)]
        stay.append(bytes(2000))
        yield len(made)
before = held()
assert list((giving_back(run) if sys.argv[1] == "task" else run)(iter([60_000]))) == [60_000]
print(held() - before)
"""


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="reads memory of a process")
def test_a_task_gives_its_memory_back():
    root = str(Path(__file__).parents[2])
    bare, task = (int(subprocess.run([sys.executable, "-c", TASK, k], cwd=root, capture_output=True, text=True, check=True).stdout) for k in ("bare", "task"))
    assert task < 20 < 80 < bare


def test_stages_of_the_pipeline_give_memory_back(spark, frame, monkeypatch):
    """All their tasks in Python, and a task of the quality classifier gets each text once."""
    kind, tasks = type(frame([(1, "a")])), []
    seen = kind.mapInArrow

    def noted(rows, run, schema, *more):
        tasks.append((run.__qualname__, rows))
        return seen(rows, run, schema, *more)

    monkeypatch.setattr(kind, "mapInArrow", noted)
    docs = frame([(k, f"text number {k} of a few words {k % 7}") for k in range(40)])
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(40)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, "an item that no text here holds at all")], "item_id long, text string")
    kept = Q.good_documents(docs, labels)
    wide = [rows for _, rows in tasks if "in_0" in rows.columns]
    assert len(wide) == 1 and sum(v == wide[0].first()["in_1"] for v in wide[0].first()) == 1
    assert kept.columns == docs.columns and {r.doc_id: r.text for r in kept.collect()}.items() <= {r.doc_id: r.text for r in docs.collect()}.items()
    H.near_duplicates_removed(docs)
    T.decontaminated(docs, items)
    S.segmented(docs)
    assert len(tasks) >= 9 and {name for name, _ in tasks} == {"giving_back.<locals>.task"}


def test_quality_of_texts_that_are_no_strings(spark, frame):
    """Columns keep their kind, as they did when the text went twice."""
    docs = frame([(k, f"text number {k}") for k in range(8)]).selectExpr("doc_id", "cast(text as binary) as text", "lang", "source")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = Q.good_documents(docs, labels)
    assert out.schema == docs.schema and out.count() == 8
