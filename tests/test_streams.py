"""Segments of one document in several micro-batches have the labels of one batch, after a restart too."""

from maskloom.streaming.segments import masked_segments

BATCHES = [
    [(1, 0, "a@b.ru и ИНН 7812345678"), (2, 0, "c@d.ru")],
    [(1, 1, "c@d.ru, a@b.ru"), (3, 0, None)],
    [(1, 2, "ИНН 7712345678, c@d.ru; 7812345678"), (2, 1, "x@y.ru c@d.ru")],
]
WANT = {
    (1, 0): "[EMAIL_1] и ИНН [ИНН_ЮЛ_1]", (1, 1): "[EMAIL_2], [EMAIL_1]", (1, 2): "ИНН [ИНН_ЮЛ_2], [EMAIL_2]; [ИНН_ЮЛ_1]",
    (2, 0): "[EMAIL_1]", (2, 1): "[EMAIL_2] [EMAIL_1]", (3, 0): "",
}
SCHEMA = "doc_id long, seg_no long, text string"


def put(spark, folder, k):
    spark.createDataFrame(BATCHES[k], SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))


def run(spark, tmp_path, each):
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", each).parquet(str(tmp_path / "in"))
    query = masked_segments(source).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(240)
    return {(r.doc_id, r.seg_no): r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()}


def test_three_batches_and_a_restart(spark, tmp_path):
    put(spark, tmp_path / "in", 0)
    assert run(spark, tmp_path, 1) == {k: v for k, v in WANT.items() if k in {(1, 0), (2, 0)}}
    put(spark, tmp_path / "in", 1)
    run(spark, tmp_path, 1)
    put(spark, tmp_path / "in", 2)
    assert run(spark, tmp_path, 1) == WANT


def test_one_batch(spark, tmp_path):
    for k in range(3):
        put(spark, tmp_path / "in", k)
    assert run(spark, tmp_path, 9) == WANT
