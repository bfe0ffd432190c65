import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskloom.llm import quality as Q

DATA = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(1)
    common = [f"{a}{b}" for a in "bcdfglmnprst" for b in ("a", "en", "io", "ur", "ost")]

    def doc(k):
        words = [rng.choice(common) + rng.choice(common) for _ in range(rng.randint(20, 80))]
        bad, toxic = k % 5 == 1, k % 7 == 2
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["vile", "nasty", "rotten"])
        text = " ".join(words)
        if bad:
            text = rng.choice([text.upper() + "!!!", " | ".join(words), (words[0] + " ") * 60])
        return (k, text, "en", f"src{k % 7}", int(not bad), int(toxic))

    rows = [doc(k) for k in range(1500)]
    docs = spark.createDataFrame([r[:4] for r in rows], "doc_id long, text string, lang string, source string").repartition(4)
    labels = spark.createDataFrame([(r[0], r[4], r[5]) for r in rows if r[0] % 2], "doc_id long, quality int, toxic int")
    return rows, docs, labels


def test_held_out_accuracy(corpus):
    rows, docs, labels = corpus
    got = {r.doc_id: r for r in Q.quality_posteriors(docs, labels).collect()}
    held = [r for r in rows if r[0] % 2 == 0]
    clean = [r for r in held if r[4] and not r[5]]
    assert sum(got[r[0]].keep for r in clean) >= 0.98 * len(clean)
    bad = [r for r in held if not r[4] or r[5]]
    assert sum(not got[r[0]].keep for r in bad) >= 0.9 * len(bad)
    toxic = [r for r in held if r[4] and r[5]]
    assert len(toxic) > 50 and sum(not got[r[0]].keep for r in toxic) >= 0.9 * len(toxic)
    assert {r.judged for r in got.values()} == {"quality,clean"}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_held_out_labels_of_the_tables(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{c}.parquet") for c in ("documents", "labels"))
    half = F.xxhash64("doc_id", F.lit(1)) % 2 == 0
    got = Q.quality_posteriors(docs, labels.where(half)).join(labels.where(~half), "doc_id").groupBy("quality", "toxic").agg(F.count("*").alias("n"), F.count_if("keep").alias("kept"))
    share = {(r.quality, r.toxic): r.kept / r.n for r in got.collect()}
    assert share[1, 0] >= 0.98 and share[0, 0] <= 0.1 and share[1, 1] <= 0.1 and share[0, 1] <= 0.1


def test_beginnings_of_unseen_insults(spark):
    rng = random.Random(5)
    ends = [a + b for a in "bdfgklmn" for b in ("a", "ur", "it", "os")]
    clean = lambda: [rng.choice(ends) + rng.choice(ends) + rng.choice(ends) for _ in range(40)]
    rows = [(k, " ".join(clean() + ([f"grobian{rng.choice(ends)}"] if k % 4 == 0 else []))) for k in range(800)]
    docs = spark.createDataFrame([(*r, "en", "s") for r in rows], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(400)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in Q.quality_posteriors(docs, labels).collect()}
    new = [k for k in range(400, 800) if k % 4 == 0]
    assert sum(not got[k].keep for k in new) >= 0.9 * len(new) and got[0].judged == "clean"


def test_filter_keeps_the_same_rows(corpus):
    _, docs, labels = corpus
    kept = {r.doc_id for r in Q.quality_posteriors(docs, labels).where("keep").collect()}
    out = Q.good_documents(docs, labels)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == kept


def test_posteriors_equal_plain_arithmetic(spark):
    rng = random.Random(2)
    rows = [(k, f"h{k % 4}", f"h{k % 4}/p{k % 12}", rng.gauss(2 - k % 4, 1), 5.0) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, host string, path string, e_quality double, e_clean double")
    sites, figures = Q.site_posteriors(df, "quality")
    p = {r[0]: 1 / (1 + math.exp(-r[3])) for r in rows}
    mean = sum(p.values()) / len(p)
    assert abs(figures["mean"] - mean) < 1e-9
    by_host = {}
    for r in rows:
        by_host.setdefault(r[1], []).append(p[r[0]])
    ssw = sum(sum((x - sum(v) / len(v)) ** 2 for x in v) for v in by_host.values())
    ssb = sum(len(v) * (sum(v) / len(v) - mean) ** 2 for v in by_host.values())
    n0 = (400 - sum(len(v) ** 2 for v in by_host.values()) / 400) / 3
    within = ssw / (400 - 4)
    weight = within / ((ssb / 3 - within) / n0)
    assert abs(figures["host_weight"] - max(1.0, weight)) < 1e-6 * figures["host_weight"]
    for r in sites.collect():
        v = by_host[r.host]
        assert abs(r.host_mean - (sum(v) + figures["host_weight"] * mean) / (len(v) + figures["host_weight"])) < 1e-9
    scored = {r.doc_id: r for r in Q._scored(df, df).withColumn("k", F.lit(1)).collect()}
    some = rows[17]
    own = [p[r[0]] for r in rows if r[2] == some[2]]
    host_mean = next(r.host_mean for r in sites.collect() if r.path == some[2])
    others = (sum(own) - p[some[0]] + figures["path_weight"] * host_mean) / (len(own) - 1 + figures["path_weight"])
    logit = lambda x: math.log(x / (1 - x))
    assert abs(logit(scored[some[0]].p_quality) - (some[3] + logit(others) - logit(mean))) < 1e-6


def test_sparse_sites_follow_their_priors(spark):
    rows = [(k, "big", "big/a", 3.0 if k % 10 else -3.0, 5.0) for k in range(300)] + [(k, "bad", "bad/a", -3.0, 5.0) for k in range(300, 500)] + [(999, "one", "one/a", 0.0, 5.0)]
    df = spark.createDataFrame(rows, "doc_id long, host string, path string, e_quality double, e_clean double")
    p = {r.doc_id: r.p_quality for r in Q._scored(df, df).collect()}
    assert abs(p[999] - 0.5) < 0.1  # a site of one document has next to no say
    assert p[301] < 1 / (1 + math.exp(3.0)) and p[1] > 1 / (1 + math.exp(-3.0))


def test_copies_count_once():
    words = [range(50), range(50), range(2, 52), range(100, 150), ()]
    assert Q.one_of_each_family(np.array([Q.signature({f"w{k}" for k in own}) for own in words])) == [0, 3, 4]


def test_awkward_rows(awkward, empty, spark):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, None), (None, 1, 1), (99, 0, 1)], "doc_id long, quality int, toxic int")
    got = Q.quality_posteriors(awkward, labels).collect()
    assert len(got) == awkward.count() and all(r.keep and r.judged == "" for r in got)  # one class only: no evidence
    two = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (5, 1, 0), (9, 0, 1)], "doc_id long, quality int, toxic int")
    assert len(Q.quality_posteriors(awkward, two).collect()) == awkward.count()
    assert Q.quality_posteriors(empty, two).count() == 0 and Q.quality_posteriors(awkward, two.where("false")).where("keep").count() == awkward.count()
    assert Q.good_documents(awkward, two.where("false")).columns == awkward.columns
