"""Masking and restoring whole tables with all rules, as projections in the JVM and joins of spans.

Texts without names to spread are masked by a projection, without any shuffle. Names that the recogniser finds spread
through their document by the posting table of ``operators.entities``; only documents with names take part in that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskloom.functions import categories as C
from maskloom.functions import native as N
from maskloom.functions import tagging as T
from maskloom.operators import entities as E
from maskloom.operators import labels as L
from maskloom.operators import spans as S
from maskloom.operators.rounds import kept

LABELS = "array<struct<category:string,n:int,label:string,value:string>>"
_SEGMENT = "array<struct<start:int,stop:int,category:string,value:string>>"


def _shifted(spans: Column, by: Column) -> Column:
    return F.transform(spans, lambda s: F.struct((s["start"] + by).alias("start"), (s["neg_stop"] - by).alias("neg_stop"), s["ord"].alias("ord"), s["category"].alias("category"), s["priority"].alias("priority")))


def _of_line(line: Column, options: T.Options) -> Column:
    found = F.concat(T.tagged_entities(T.entity_rows(line, T.recognised(line), options)), T.rule_spans(line, options))
    return F.when(line.rlike(r"(?U)\S"), found).otherwise(F.array().cast(T.TAGGED))


def raw_spans(text: Column, options: T.Options = T.Options()) -> Column:
    """Tagged spans of a whole text, whose segments are its lines: overlaps included, positions in the text."""
    lines = S.lines(text)
    low = lambda line, words: F.lit(False) if not words else _any(line, words)
    switch = lambda line: F.when(low(line, C.SECTION_ON), 1).when(low(line, C.SECTION_OFF), 2).otherwise(0)

    def whole(x: Column) -> Column:
        ends = N.running(F.transform(x["lines"], F.length), lambda a, b: a + b)
        on = N.running(F.transform(x["lines"], switch), lambda a, b: F.when(b == 0, a).otherwise(b)) if options.smart_contract else F.array()
        here = F.struct(x["lines"].alias("lines"), ends.alias("ends"), on.cast("array<int>").alias("on"))
        active = (lambda y, i: F.coalesce(F.get(y["on"], i), F.lit(0)) != 2) if options.smart_contract else (lambda y, i: F.lit(True))
        own = lambda y, line, i: F.when(active(y, i), _shifted(_of_line(line, options), F.get(y["ends"], i) - F.length(line))).otherwise(F.array().cast(T.TAGGED))
        return N.let(here, lambda y: F.flatten(F.transform(y["lines"], lambda line, i: own(y, line, i))))

    return N.let(F.struct(lines.alias("lines")), whole)


def _any(line: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.lower(line).contains(w)
    return out


def _text_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def _names(rows: DataFrame, options: T.Options) -> DataFrame:
    """doc_id, category, value of the entities of all lines."""
    names = N.built(("recognised in text", options), lambda: T.entity_rows(F.col("text"), T.recognised(F.col("text")), options))
    found = S.lines_of(rows).select("doc_id", F.explode(names).alias("e"))
    return found.select("doc_id", "e.category", "e.value")


def _placed(docs: DataFrame) -> DataFrame:
    """A segment for each line, its number being where it begins in the text."""
    at = lambda x: F.transform(x["lines"], lambda line, i: F.struct((F.get(x["ends"], i) - F.length(line)).cast("long").alias("seg_no"), line.alias("text")))
    with_ends = lambda x: F.struct(x["lines"].alias("lines"), N.running(F.transform(x["lines"], F.length), lambda a, b: a + b).alias("ends"))
    found = N.let(N.let(F.struct(S.lines(F.col("text")).alias("lines")), with_ends), at)
    return docs.select("doc_id", F.explode(found).alias("l")).select("doc_id", "l.seg_no", "l.text")


def _with_raw(docs: DataFrame, options: T.Options) -> DataFrame:
    """doc_id, text, raw: all tagged spans, spread terms included. ``docs``: doc_id, text."""
    text, none = F.coalesce("text", F.lit("")), F.array().cast(T.TAGGED)
    raw = N.built(("raw spans of text", options), lambda: raw_spans(text, options))
    plain = docs.select("doc_id", "text", F.explode(F.array(raw)).alias("raw"))  # Generate: the matches are made once
    if not options.spread:
        return plain
    has_names = F.coalesce(F.col("text").rlike(T.R.MARKS["я"]) & F.col("text").rlike(T.R.PEOPLE), F.lit(False))
    # read many times below, so that it is computed once; mostly few or none, and then the rules are a projection alone
    named = kept(docs.where(has_names))
    if named.isEmpty():
        return plain
    lines = _placed(named)
    places = S.switched(lines).where("masking") if options.smart_contract else lines
    spread = E.terms_spread(places.select("doc_id", "seg_no", "text"), kept(E.terms_of(_names(named, options))))
    moved = spread.select("doc_id", F.struct((F.col("start") + F.col("seg_no")).cast("int").alias("start"), (F.col("stop") + F.col("seg_no")).cast("int").alias("stop"), "category").alias("e"))
    extra = moved.groupBy("doc_id").agg(T.tagged_entities(F.collect_set("e"), 99).alias("extra")).hint("merge")  # as in ``entities.terms_spread``
    # the rules stand once in the plan, over all texts: those without names as they are, the others with what spreads
    rows = docs.where(~has_names).select("doc_id", "text", none.alias("extra")).unionByName(named.select("doc_id", "text").join(extra, "doc_id", "left").select("doc_id", "text", F.coalesce("extra", none).alias("extra")))
    found = rows.select("doc_id", "text", "extra", F.explode(F.array(raw)).alias("raw"))
    return found.select("doc_id", "text", F.concat("raw", "extra").alias("raw"))


def _merged(docs: DataFrame, options: T.Options) -> DataFrame:
    """doc_id, text, spans (merged, with values)."""
    rows = _with_raw(docs, options)
    merged = N.built(("merged raw",), lambda: N.merged(F.col("raw"), F.coalesce("text", F.lit(""))))
    return rows.select("doc_id", "text", F.explode(F.array(merged)).alias("spans"))


def anonymize(docs: DataFrame, options: T.Options | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text (masked), labels, n_spans of documents with an id each. Lines are the segments; a null text stays null.

    Labels are sensitive: they are returned, never written here. Rebuild them from the unchanged original
    instead of storing them.
    """
    options = options or T.Options()
    found = _merged(_text_rows(docs, id_col, text_col), options)
    rows = found.select("doc_id", "text", F.explode(F.array(N.built(("numbered spans",), lambda: N.numbered(F.col("spans"))))).alias("spans"))
    name = (lambda s: N.label(s["category"], s["n"])) if options.numbered else (lambda s: F.concat(F.lit("["), s["category"], F.lit("]")))
    labels = F.array_distinct(F.transform("spans", lambda s: F.struct(s["category"].alias("category"), s["n"].alias("n"), name(s).alias("label"), s["value"].alias("value"))))
    return rows.select("doc_id", N.spliced(F.col("text"), F.col("spans"), name).alias("text"), labels.cast(LABELS).alias("labels"), F.size("spans").cast("long").alias("n_spans"))


def found(docs: DataFrame, options: T.Options | None = None) -> DataFrame:
    """doc_id, start, stop, category, value: the merged spans of whole documents (doc_id, text) by all rules; positions in the text."""
    rows = _merged(_text_rows(docs, "doc_id", "text"), options or T.Options()).select("doc_id", F.explode("spans").alias("s"))
    return rows.select("doc_id", F.col("s.start").cast("long").alias("start"), F.col("s.stop").cast("long").alias("stop"), "s.category", "s.value")


def rules_found(docs: DataFrame, dates: bool = False, only: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, rule, start, stop, value: what each rule (or those named ``only``) finds in whole documents, checks applied, before overlaps are united."""
    names = F.array(*(F.lit(r.name) for r in (*T.R.RULES, T.R.DATES)))
    chosen = tuple(r for r in (*T.R.RULES, T.R.DATES) if r.name in only) or None

    def whole(x: Column) -> Column:
        ends = N.running(F.transform(x["lines"], F.length), lambda a, b: a + b)
        here = F.struct(x["lines"].alias("lines"), ends.alias("ends"))
        moved = lambda r, by: F.struct(r["ord"].alias("ord"), (r["start"] + by).alias("start"), (r["stop"] + by).alias("stop"), r["value"].alias("value"))
        own = lambda y, line, i: F.transform(T.rule_rows(line, dates, chosen), lambda r: moved(r, F.get(y["ends"], i) - F.length(line)))
        return N.let(here, lambda y: F.flatten(F.transform(y["lines"], lambda line, i: own(y, line, i))))

    lines = S.lines(F.col("text"))
    every = N.built(("rule rows of lines", dates, only), lambda: N.let(F.struct(lines.alias("lines")), whole))
    rows = docs.where("text is not null").select("doc_id", F.explode(every).alias("r"))
    return rows.select("doc_id", F.get(names, F.col("r.ord")).alias("rule"), F.col("r.start").cast("long").alias("start"), F.col("r.stop").cast("long").alias("stop"), "r.value")


def segment_spans(segments: DataFrame, options: T.Options | None = None) -> DataFrame:
    """doc_id, seg_no, start, stop, category, value: merged spans of segments (doc_id, seg_no, text, entities). Fails if a segment has no entities."""
    options = options or T.Options()
    missing = F.raise_error(F.lit("a segment has no entities: masking stops rather than let names through"))
    rows = segments.select("doc_id", "seg_no", F.coalesce("text", F.lit("")).alias("text"), F.when(F.col("entities").isNull(), missing.cast(E.ENTITIES)).otherwise(F.col("entities").cast(E.ENTITIES)).alias("entities"))
    if options.smart_contract:
        rows = S.switched(rows)
    names = N.built(("entities of text", options), lambda: T.entity_rows(F.col("text"), F.col("entities"), options))
    own = F.concat(T.tagged_entities(names), N.built(("rule spans of text", options), lambda: T.rule_spans(F.col("text"), options)))
    active = F.col("text").rlike(r"(?U)\S") & (F.col("masking") if options.smart_contract else F.lit(True))
    found = rows.select("doc_id", "seg_no", "text", *(["masking"] if options.smart_contract else []), F.explode(F.array(F.when(active, own).otherwise(F.array().cast(T.TAGGED)))).alias("raw"))
    if options.spread:
        terms = E.terms_of(rows.select("doc_id", F.explode(names).alias("e")).select("doc_id", "e.category", "e.value"))
        places = (rows.where("masking") if options.smart_contract else rows).select("doc_id", "seg_no", "text")
        spread = E.terms_spread(places, terms).groupBy("doc_id", "seg_no").agg(T.tagged_entities(F.collect_set(F.struct("start", "stop", "category")), 99).alias("extra")).hint("merge")
        found = found.join(spread, ["doc_id", "seg_no"], "left").withColumn("raw", F.concat("raw", F.coalesce("extra", F.array().cast(T.TAGGED))))
    merged = found.select("doc_id", "seg_no", F.explode(N.merged(F.col("raw"), F.col("text"))).alias("s"))
    return merged.select("doc_id", "seg_no", "s.*")


def anonymize_segments(segments: DataFrame, options: T.Options | None = None) -> tuple[DataFrame, DataFrame]:
    """Masked segments (doc_id, seg_no, text) and their label table, from segments with entities (see ``operators.entities``).

    Numbers run through the document in the order of seg_no. Fails if a segment has no entities.
    """
    options = options or T.Options()
    numbered = L.numbered(segment_spans(segments, options))
    put = F.col("label") if options.numbered else F.concat(F.lit("["), "category", F.lit("]"))
    masked = S.spliced(segments.select("doc_id", "seg_no", F.coalesce("text", F.lit("")).alias("text")), numbered.withColumn("put", put))
    return masked, L.label_table(numbered)


def label_rows(masked: DataFrame) -> DataFrame:
    """doc_id, category, n, value from the labels column of ``anonymize``."""
    return masked.select("doc_id", F.explode("labels").alias("l")).select("doc_id", "l.category", "l.n", "l.value")


def restore(answers: DataFrame, masked: DataFrame) -> DataFrame:
    """answers: doc_id, text; masked: doc_id, labels as ``anonymize`` gives them. See ``labels.restored``."""
    return L.restored(answers, label_rows(masked))
