"""Quality and toxicity by a document classifier and hierarchical empirical Bayes over hosts and paths.

Two logistic classifiers, for quality and for toxicity, are fitted on at most ``sample`` labelled
documents (those with the smallest hashes of their doc_id, so the same at any layout), over the
presence of words, of beginnings of words, and a few figures of form. Every document's probabilities are then aggregated, by
path and then by host: counts, sums and sums of squares, all summed before the shuffle. The spread
between hosts, and between the paths of a host, against the spread within them gives the weight of a
prior (analysis of variance, method of moments). A host's mean is shrunk toward the global mean and a
path's mean toward its host's, the more the fewer documents they have. A document's posterior odds are
its own odds times the odds that its path's mean, without the document itself, adds to the global mean.
A document is kept if both its quality and its absence of toxicity are at least ``keep`` probable.

``source`` is the host and ``source`` with ``lang`` the path.

Cases: a null text is an empty one and is scored by its form; a null source or language is the empty
name; labelled rows without a document, and null labels, aren't used, and of several labels of one
document the smallest quality and largest toxicity count; without labels of both classes a classifier
gives no evidence (0.5), nothing is rejected for it, and ``judged`` doesn't name it. Rows that repeat are each scored and counted. Other columns are ignored, and kept by ``good_documents``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from maskloom.llm.common import checkpointed, mapped, sliced

_WORD = re.compile(r"[^\W\d_]+")
_UPPER = bytes(range(65, 91))
_OTHER = bytes(x for x in range(33, 127) if not chr(x).isalnum() and chr(x) not in ".,;:'\"-()?|!")
N_FORM = 8
_PREFIX = range(4, 9)


def features(text: str | None) -> tuple[set[str], list[float]]:
    """Words, and figures of form between about 0 and 1."""
    text = text or ""
    words = _WORD.findall(text)
    raw = text.encode("utf-8", "replace")
    share = lambda chars: (len(raw) - len(raw.translate(None, chars))) / max(1, len(raw))
    counts = Counter(words)
    n = len(words)
    return {w.lower() for w in counts}, [
        share(_UPPER), min(1.0, 5 * share(b"|")), min(1.0, 5 * share(_OTHER)), min(1.0, 5 * share(b"!")), min(1.0, 5 * share(b"0123456789")),
        (max(counts.values(), default=1) - 1) / max(1, n), (n - len(counts)) / max(1, n), min(1.0, np.log1p(n) / 10),
    ]


def tokens(words: set[str]) -> set[str]:
    """Words, and beginnings of ``_PREFIX`` letters behind a mark: insults that no labelled text holds often begin like those that one does."""
    return words | {"^" + w[:k] for w in words for k in _PREFIX if k < len(w)}


def signature(words: set[str], size: int = 96) -> np.ndarray:
    """Minimum hashes of a set of words; two sets agree in about the share that they have in common."""
    h = np.array([xxhash.xxh64_intdigest(w, 1) for w in words] or [0], np.uint64)
    mix = np.random.default_rng(7).integers(1, 1 << 63, (2, size), dtype=np.uint64) | np.uint64(1)
    low = np.full(size, np.iinfo(np.uint64).max)
    for at in range(0, len(h), 4096):
        low = np.minimum(low, (h[at : at + 4096, None] * mix[0] + mix[1]).min(axis=0))
    return (low >> np.uint64(32)).astype(np.uint32)


def one_of_each_family(signatures: np.ndarray, rows: int = 8, alike: float = 0.7) -> list[int]:
    """The first of each family of copies, whose words would else pass for independent evidence: texts
    that agree in ``alike`` of their signatures or more, found by bands of ``rows`` minimum hashes."""
    seen: dict[tuple, list[int]] = {}
    first = []
    for k, own in enumerate(signatures):
        keys = [(b, own[b : b + rows].tobytes()) for b in range(0, len(own), rows)]
        near = list(dict.fromkeys(j for x in keys for j in seen.get(x, ())))
        if not near or ((signatures[near] == own).mean(axis=1) < alike).all():
            first.append(k)
            for x in keys:
                seen.setdefault(x, []).append(k)
    return first


@dataclass
class Sample:
    """Labelled texts: figures of form, labels, and which of the telling tokens each holds (row, token). As the driver holds it: no words but those."""

    form: np.ndarray
    label: dict[str, np.ndarray]
    row: np.ndarray
    token: np.ndarray
    names: list[str]
    chosen: dict[str, np.ndarray]  # by label: the numbers of the tokens that tell something about it


class Logistic:
    """L2-regularised logistic regression over word presence and figures of form, fitted by Adagrad over the whole sample."""

    def __init__(self, sample: Sample, label: str, penalty: float, steps: int):
        y, chosen = sample.label[label].astype(float), sample.chosen[label]
        self.weights: dict[str, float] = {}
        share = float(y.mean()) if len(y) else 0.0
        self.form, self.bias = np.zeros(N_FORM), 0.0
        self.fitted = 0 < share < 1
        if not self.fitted:
            return  # no evidence
        self.bias = float(np.log(share / (1 - share)))
        place = np.full(len(sample.names), -1)
        place[chosen] = np.arange(len(chosen))
        used = place[sample.token] >= 0
        row, col, form, k = sample.row[used], place[sample.token[used]], sample.form, len(chosen)
        w, v, b = np.zeros(k), np.zeros(N_FORM), self.bias
        scale_w, scale_v = np.zeros(k), np.zeros(N_FORM)  # rare words move as fast as common ones
        for _ in range(steps):
            z = b + form @ v + np.bincount(row, w[col], len(y))
            g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
            gw, gv = np.bincount(col, g[row], k) + penalty * w, form.T @ g + penalty * 0.1 * v
            scale_w, scale_v = scale_w + gw * gw, scale_v + gv * gv
            w = w - 0.5 * gw / np.sqrt(scale_w + 1e-9)
            v = v - 1.0 * gv / np.sqrt(scale_v + 1e-9)
            b -= 0.05 * float(g.mean())
        self.weights = {sample.names[int(x)]: float(y) for x, y in zip(chosen, w, strict=True)}
        self.form, self.bias = v, b

    def odds(self, held: set[str], form: list[float]) -> float:
        """Log odds of a text with these tokens."""
        return float(np.clip(self.bias + self.form @ form + sum(self.weights.get(t, 0.0) for t in sorted(held)), -12, 12))


class Scorer:
    """Log odds of texts by several classifiers."""

    def __init__(self, models: tuple[Logistic, ...]):
        self.models = models
        self.known = frozenset().union(*(m.weights for m in models))
        self.starts = frozenset(t[1 : 1 + _PREFIX[0]] for t in self.known if t[0] == "^")

    def __call__(self, texts: list[str | None]) -> list[list[float]]:
        known, starts, least = self.known, self.starts, _PREFIX[0]
        out: list[list[float]] = [[] for _ in self.models]
        for text in texts:
            words, form = features(text)
            held = words & known
            for w in words:
                if w[:least] in starts:  # few words begin like a token that counts
                    held |= tokens({w}) & known
            for scores, m in zip(out, self.models, strict=True):
                scores.append(m.odds(held, form))
        return out


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int, least: int, chi2: float, most: int) -> Sample:
    """At most ``sample`` labelled documents, one of each family of copies, with the ``most`` most telling tokens for each label.

    Telling are tokens of ``least`` texts or more whose presence and the label depend on each other (chi-square
    of the two by two table); the threshold is far beyond what the number of tokens tried can give by chance.
    """
    known = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # bounded by ``sample``
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = checkpointed(rows.select(F.xxhash64("doc_id", "text").alias("key"), "text", (F.col("quality") > 0).alias("quality"), (F.col("toxic") > 0).alias("toxic")))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            found = [features(t) for t in b.column(1).to_pylist()]
            marks = pa.array([signature(w).tobytes() for w, _ in found], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), marks, pa.array([f for _, f in found], pa.list_(pa.float64())), b.column(2), b.column(3)], ["key", "marks", "form", "quality", "toxic"])

    held = mapped(rows, sketch, "key long, marks binary, form array<double>, quality boolean, toxic boolean").toArrow()
    held = held.sort_by("key")
    marks = np.array([np.frombuffer(x, np.uint32) for x in held.column("marks").to_pylist()])
    held = held.take(np.array(one_of_each_family(marks), int))
    label = {c: held.column(c).to_numpy() for c in ("quality", "toxic")}
    keys = held.column("key").to_numpy()
    place = docs.sparkSession.sparkContext.broadcast({int(k): r for r, k in reversed(list(enumerate(keys)))})

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            count: dict[str, list[int]] = {}
            for key, text, *own in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key in place.value:
                    for t in tokens(features(text)[0]):
                        c = count.setdefault(t, [0, 0, 0])
                        c[0] += 1
                        c[1] += own[0]
                        c[2] += own[1]
            columns = [pa.array([c[k] for c in count.values()], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), *columns], ["token", "df", "quality", "toxic"])

    n = float(len(keys))
    counts = mapped(rows, counted, "token string, df long, quality long, toxic long").groupBy("token").agg(*(F.sum(c).cast("double").alias(c) for c in ("df", "quality", "toxic"))).where((F.col("df") >= least) & (F.col("df") < n))
    counts, telling = checkpointed(counts), {}
    for c in ("quality", "toxic"):
        pos = float(label[c].sum())
        df, off = F.col("df"), F.col(c) * n - F.col("df") * pos
        score = F.lit(n) * off * off / (df * (n - df) * pos * (n - pos))
        telling[c] = [r[0] for r in counts.select("token", score.alias("s")).where(F.col("s") >= chi2).orderBy(F.desc("s"), "token").limit(most).collect()] if 0 < pos < n else []
    names = sorted({t for own in telling.values() for t in own})
    number = docs.sparkSession.sparkContext.broadcast({t: k for k, t in enumerate(names)})

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            found = [(place.value[key], k) for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if key in place.value for t in tokens(features(text)[0]) if (k := number.value.get(t)) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.int32())], ["row", "token"])

    at = mapped(rows, placed, "row int, token int").distinct().toArrow().sort_by([("row", "ascending"), ("token", "ascending")])
    form = np.array(held.column("form").to_pylist(), float).reshape(-1, N_FORM)
    return Sample(form, label, at.column("row").to_numpy(), at.column("token").to_numpy(), names, {c: np.array([number.value[t] for t in own], int) for c, own in telling.items()})


def fitted(docs: DataFrame, labels: DataFrame, sample: int = 12000, least: int = 5, chi2: float = 40.0, most: int = 1024, penalty: float = 1.0, steps: int = 200) -> tuple[Logistic, Logistic]:
    """Classifiers of quality and of toxicity."""
    rows = labelled_sample(docs, labels, sample, least, chi2, most)
    return tuple(Logistic(rows, c, penalty, steps) for c in ("quality", "toxic"))


def with_evidence(docs: DataFrame, models: tuple[Logistic, Logistic], text: str = "text") -> DataFrame:
    """``docs`` with ``e_quality`` and ``e_clean``, log odds by the text alone, which column ``text`` holds."""
    sent, at = docs.sparkSession.sparkContext.broadcast(models), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(sent.value)
        for b in sliced(batches):
            quality, toxic = score(b.column(at).to_pylist())
            odds = [pa.array(quality, pa.float64()), pa.array([-x for x in toxic], pa.float64())]
            yield pa.RecordBatch.from_arrays([*b.columns, *odds], [*b.schema.names, "e_quality", "e_clean"])

    return mapped(docs, run, StructType([*docs.schema.fields, *(StructField(c, DoubleType()) for c in ("e_quality", "e_clean"))]))


def _p(odds: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (F.lit(1.0) - p))


def _weight(ssb: float, ssw: float, n: float, groups: float, inside: float, n0: float) -> float:
    """Documents that the prior counts for: variance within groups over variance between them."""
    within = max(ssw / max(1.0, n - inside), 1e-9)
    between = (ssb / max(1.0, groups) - within) / max(n0, 1e-9)
    return float(min(1e6, max(1.0, within / between))) if between > 0 else 1e6


def path_sums(evidence: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """host, path, n, and for each name s and q, the sums of probabilities and of their squares. One aggregation for all names."""
    sums = [x for c in names for p in (_p(F.col(f"e_{c}")),) for x in (F.sum(p).alias(f"s_{c}"), F.sum(p * p).alias(f"q_{c}"))]
    return checkpointed(evidence.groupBy("host", "path").agg(F.count("*").cast("double").alias("n"), *sums))


def site_posteriors(evidence: DataFrame, name: str, sums: DataFrame | None = None) -> tuple[DataFrame, dict]:
    """evidence: host, path, e_<name>. Returns a row per path (n, s, and the host's shrunk mean) and the global figures."""
    paths = (path_sums(evidence, (name,)) if sums is None else sums).select("host", "path", "n", F.col(f"s_{name}").alias("s"), F.col(f"q_{name}").alias("q"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"), F.sum("q").alias("hq"), F.count("*").alias("k"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("ps"), F.sum(F.col("n") * F.col("n")).alias("nn"))
    t = hosts.agg(F.sum("hn").alias("n"), F.sum("hs").alias("s"), F.sum("hq").alias("q"), F.count("*").alias("hosts"), F.sum("k").alias("paths"), F.sum("ps").alias("ps"), F.sum(F.col("hs") * F.col("hs") / F.col("hn")).alias("hs2"), F.sum(F.col("hn") * F.col("hn")).alias("hn2"), F.sum(F.col("nn") / F.col("hn")).alias("pn2")).first()
    if not t["n"]:
        return paths.select("host", "path", "n", "s", F.lit(0.5).alias("host_mean")), {"mean": 0.5, "host_weight": 1.0, "path_weight": 1.0}
    n, mean = t["n"], t["s"] / t["n"]
    host_weight = _weight(t["hs2"] - n * mean * mean, t["q"] - t["hs2"], n, t["hosts"] - 1, t["hosts"], (n - t["hn2"] / n) / max(1, t["hosts"] - 1))
    path_weight = _weight(t["ps"] - t["hs2"], t["q"] - t["ps"], n, t["paths"] - t["hosts"], t["paths"], (n - t["pn2"]) / max(1, t["paths"] - t["hosts"]))
    shrunk = (F.col("hs") + F.lit(host_weight * mean)) / (F.col("hn") + F.lit(host_weight))
    out = paths.join(hosts.select("host", shrunk.alias("host_mean")), "host").select("host", "path", "n", "s", "host_mean")
    return out, {"mean": mean, "host_weight": host_weight, "path_weight": path_weight}


def _posterior(name: str, figures: dict) -> Column:
    own = _p(F.col(f"e_{name}"))
    weight = F.lit(figures["path_weight"])
    others = (F.col(f"s_{name}") - own + weight * F.col(f"host_mean_{name}")) / (F.col(f"n_{name}") - 1 + weight)
    return _p(F.col(f"e_{name}") + _logit(others) - _logit(F.lit(figures["mean"])))


def _names() -> tuple[Column, Column]:
    host = F.coalesce(F.col("source").cast("string"), F.lit(""))
    return host.alias("host"), F.concat(host, F.lit("/"), F.coalesce(F.col("lang").cast("string"), F.lit(""))).alias("path")


def _scored(rows: DataFrame, evidence: DataFrame) -> DataFrame:
    """``rows``, which have host, path and evidence, with posteriors from all of ``evidence``."""
    sites, all_figures = None, {}
    sums = path_sums(evidence, ("quality", "clean"))
    for name in ("quality", "clean"):
        found, all_figures[name] = site_posteriors(evidence, name, sums)
        found = found.select("host", "path", *(F.col(c).alias(f"{c}_{name}") for c in ("n", "s", "host_mean")))
        sites = found if sites is None else sites.join(found, ["host", "path"])
    rows = rows.join(checkpointed(sites), ["host", "path"], "left")
    for name in ("quality", "clean"):
        rows = rows.withColumn(f"p_{name}", _posterior(name, all_figures[name]))
    return rows


def _kept(keep: float) -> Column:
    return (F.col("p_quality") >= keep - 1e-9) & (F.col("p_clean") >= keep - 1e-9)


def quality_posteriors(docs: DataFrame, labels: DataFrame, keep: float = 0.5, sample: int = 12000) -> DataFrame:
    """doc_id, host, path, text_quality, text_clean (by the text alone), p_quality, p_clean, keep, and judged:
    which of the two classifiers had labels of both classes (quality, clean; the other lets everything through)."""
    models = fitted(docs, labels, sample)
    judged = ",".join(c for c, m in zip(("quality", "clean"), models, strict=True) if m.fitted)
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_names(), F.col("text").cast("string").alias("text"))
    evidence = checkpointed(with_evidence(named, models).drop("text"))
    return _scored(evidence, evidence).select(
        "doc_id", "host", "path", _p(F.col("e_quality")).alias("text_quality"), _p(F.col("e_clean")).alias("text_clean"), "p_quality", "p_clean",
        _kept(keep).alias("keep"), F.lit(judged).alias("judged"),
    )


def good_documents(docs: DataFrame, labels: DataFrame, keep: float = 0.5, sample: int = 12000) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns. Texts are scored twice rather than shuffled."""
    models = fitted(docs, labels, sample)
    columns = [F.col(c).alias(f"in_{k}") for k, c in enumerate(docs.columns)]
    as_text = F.col("text").cast("string").alias("text")
    evidence = with_evidence(docs.select(*_names(), as_text), models).drop("text")
    if isinstance(docs.schema["text"].dataType, StringType):  # a task gets and returns each text once
        rows = with_evidence(docs.select(*columns, *_names()), models, f"in_{docs.columns.index('text')}")
    else:
        rows = with_evidence(docs.select(*columns, *_names(), as_text), models)
    scored = _scored(rows, checkpointed(evidence))
    return scored.where(_kept(keep)).select(*(F.col(f"in_{k}").alias(c) for k, c in enumerate(docs.columns)))
