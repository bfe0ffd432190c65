"""Sources of recognised entities, and the spreading of what they find. No model is shipped: a source is a plug-in.

A source adds a column ``entities`` to segments: array<struct<start:int,stop:int,type:string>>, null where
it failed. Terms spread by a posting table of words: each word of a text with its place and form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskloom.functions import categories as C
from maskloom.functions import native as N
from maskloom.functions import tagging as T
from maskloom.functions import words as W

ENTITIES = T.ENTITIES
#: A word as postings have it, and as terms are made of.
TOKEN = r"[\p{L}\p{M}\p{N}_]+"
_WORD = "[A-Za-zА-Яа-яЁё]+"
_TAILS = ("[а-яё]{0,4}", "[a-z]{0,3}")
LONGEST_TAIL = 4
_BEGIN = 5


def with_rule_entities(segments: DataFrame) -> DataFrame:
    """Entities of the small recogniser."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return segments.withColumn("entities", T.recognised(text))


def with_table_entities(segments: DataFrame, spans: DataFrame, status: DataFrame) -> DataFrame:
    """Entities from a table (doc_id, seg_no, start, stop, type); ``status`` (doc_id, seg_no) says which segments
    were looked at, all others get null and so stop the masking."""
    by_segment = spans.groupBy("doc_id", "seg_no").agg(F.array_sort(F.collect_list(F.struct(F.col("start").cast("int"), F.col("stop").cast("int"), "type"))).cast(ENTITIES).alias("entities"))
    seen = status.select("doc_id", "seg_no").distinct().withColumn("seen", F.lit(True))
    rows = segments.join(seen, ["doc_id", "seg_no"], "left").join(by_segment, ["doc_id", "seg_no"], "left")
    return rows.select(*segments.columns, F.when(F.col("seen"), F.coalesce("entities", F.array().cast(ENTITIES))).alias("entities"))


def terms_of(found: DataFrame) -> DataFrame:
    """Terms to spread, from what was recognised (doc_id, category, value): doc_id, term, category.

    People and organisations give whole names of two words or more, and single words of four letters or more that name
    no role; a word of both is a person's.
    """
    names = found.where(F.col("category").isin(C.PERSON, C.ORG)).select("doc_id", "category", F.trim("value").alias("value"))
    whole = names.where((F.length("value") >= 5) & F.col("value").contains(" ")).select("doc_id", F.col("value").alias("term"), "category")
    single = names.select("doc_id", F.explode(F.regexp_extract_all("value", F.lit(_WORD), F.lit(0))).alias("term"), "category").where((F.length("term") >= 4) & ~F.col("term").rlike("^" + W.ROLE_WORD))
    person = F.max(F.col("category") == C.PERSON)
    return whole.unionByName(single).groupBy("doc_id", "term").agg(F.when(person, C.PERSON).otherwise(C.ORG).alias("category"))


def postings(segments: DataFrame) -> DataFrame:
    """doc_id, seg_no, start, stop, form (in lower case), small: every word of every segment; ``small``: it begins with a small letter."""
    words = segments.where("text is not null").select("doc_id", "seg_no", F.explode(N.match_spans(F.col("text"), TOKEN)).alias("w"))
    return words.select("doc_id", "seg_no", "w.start", "w.stop", F.lower("w.value").alias("form"), F.col("w.value").rlike(r"^\p{Ll}").alias("small"))


def terms_spread(segments: DataFrame, terms: DataFrame) -> DataFrame:
    """Where the terms of a document (doc_id, term, category) stand in its segments: doc_id, seg_no, term, category, start, stop.

    A single word stands wherever a word begins with its root (without its last two letters, of five letters at least)
    and ends in up to four more Cyrillic or three Latin letters; one that a document also has with a small first letter is a
    common noun and left out. Forms meet roots by an equal beginning, so a document's terms are never tried one by one on
    its text. Terms of several words stand where their first word does and the text goes on like them, in any case.

    Words and terms grow with the texts, but Spark's guess at their size need not: texts made of keys, and what is kept of them, count as
    small and would be broadcast by way of the driver. So the joins here are by shuffles.
    """
    own = segments.join(terms.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi")
    words = postings(own)
    low = terms.where("term <> ''").select("doc_id", "term", "category", F.lower("term").alias("low"))

    size = F.length("low")
    names = low.where(F.col("low").rlike(rf"^{TOKEN}$")).withColumn("root", F.when(size > 5, F.substring(F.col("low"), F.lit(1), F.greatest(size - 2, F.lit(5)))).otherwise(F.col("low")))
    # forms and roots meet by their first letters, five at most: once a form, and again for each length of roots that are shorter
    shorter = [r[0] for r in names.select(F.length("root").alias("n")).where(F.col("n") < _BEGIN).distinct().collect()]
    names = names.withColumn("begin", F.substring("root", 1, _BEGIN))
    n = F.length("form")
    begins = F.array_compact(F.array(F.substring("form", 1, _BEGIN), *(F.when((n > k) & (n <= k + LONGEST_TAIL), F.substring("form", 1, k)) for k in sorted(shorter))))
    # a form carries its places, so that words are dealt out once
    forms = words.groupBy("doc_id", "form").agg(F.max("small").alias("small"), F.collect_list(F.struct("seg_no", "start", "stop")).alias("places"))
    pairs = forms.select("doc_id", "form", "small", "places", F.explode(begins).alias("begin")).join(names.hint("merge"), ["doc_id", "begin"]).where(F.col("form").startswith(F.col("root")))
    common = F.max(F.col("small") & (F.col("form") == F.col("low"))).over(Window.partitionBy("doc_id", "low"))
    rest = F.expr("substring(form, length(root) + 1)")
    fits = F.when(F.col("root").rlike("[а-яё]$"), rest.rlike(f"^{_TAILS[0]}$")).otherwise(rest.rlike(f"^{_TAILS[1]}$"))
    hits = pairs.withColumn("common", common).where(~F.col("common") & fits).select("doc_id", "term", "category", F.explode("places").alias("p"))
    spans = hits.select("doc_id", "p.seg_no", "term", "category", "p.start", "p.stop")

    several = low.where(~F.col("low").rlike(rf"^{TOKEN}$")).withColumn("form", F.regexp_extract("low", TOKEN, 0)).where("form <> ''").withColumn("lead", F.instr("low", F.col("form")) - 1)
    if several.isEmpty():
        return spans
    begins = words.select("doc_id", "seg_no", "start", "form").join(several.hint("merge"), ["doc_id", "form"]).withColumn("from", F.col("start") - F.col("lead")).where("from >= 0")
    here = begins.join(own.select("doc_id", "seg_no", "text").hint("merge"), ["doc_id", "seg_no"]).where(F.lower(F.expr("substring(text, from + 1, length(term))")) == F.col("low"))
    return spans.unionByName(here.select("doc_id", "seg_no", "term", "category", F.col("from").alias("start"), (F.col("from") + F.length("term")).alias("stop")))
