"""How five document filters interact, in every order that they can be applied in.

A document is described by the set of filters it fails, whatever the order. An order is a path through
the lattice of subsets: its step from the already applied subset S to S and filter f is an edge, and what
happens there depends on (S, f) alone. So documents contribute to the 80 edges, and the 600 steps of the
120 orders are joined to the aggregated edges instead of being run one by one.

Filters, each by its failure: A too few words, B too few distinct words, C too many capitals, D a sign of
junk, E a copy of a text with a smaller doc_id anywhere in the table, removed or not.

At an edge a document that fails nothing in S is ``removed`` if it fails f, and ``kept`` otherwise; one
that fails both f and something in S is ``redundant``. ``unique_fails`` counts those that fail f alone.
``shapley`` weighs the removed of the 16 edges of a filter by the number of orders that cross them.

Everything is a DataFrame operation. Texts are reduced to flags and a SHA-256 where they are read; copies
have the same flags, so counts are summed up by digest, labels and language before they are shuffled, and a
text that many documents share needs no join.

Cases: a null text is an empty one, which fails A, and E behind the first; a null lang is the part of the
empty string; a null doc_id counts as larger than any other and has no labels; rows of one doc_id don't
make each other copies, and each row counts as a document; of several labels of a document any with
quality=1 (toxic=1) counts, of labels no other value does; an empty table has no parts and so no rows.
Other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
_BIT = {f: 1 << k for k, f in enumerate(FILTERS)}
_SPACE = r"[\x20\x09-\x0D]+"
_COUNTS = ("n", "good", "toxic")


def failures(text: Column) -> Column:
    """Bits of the filters A to D that a text fails."""
    words = F.array_remove(F.split(text, _SPACE, -1), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = {"A": n < 100, "B": 100 * distinct < 80 * n, "C": 100 * capitals > 10 * F.length(text), "D": text.rlike("[#$%&*|]")}
    return sum((F.when(c, _BIT[f]).otherwise(0) for f, c in fails.items()), F.lit(0))


def profiles(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, fails (bits of A to E) and the number of documents, good ones and toxic ones: at most 32 rows a part."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.select("doc_id", "part", F.sha2("text", 256).alias("digest"), failures(F.col("text")).alias("fails"))
    # rows without an id are spread by their text
    rows = rows.withColumn("key", F.coalesce("doc_id", F.xxhash64("digest"))).withColumn("named", F.col("doc_id").isNotNull())
    flags = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("key")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("int")).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("int")).alias("toxic")
    )
    rows = rows.join(flags.withColumn("named", F.lit(True)), ["key", "named"], "left")
    each = rows.groupBy("key", "named", "doc_id", "digest", "part", "fails", F.coalesce("good", F.lit(0)).alias("is_good"), F.coalesce("toxic", F.lit(0)).alias("is_toxic")).agg(F.count("*").alias("n"))
    # of each text only the rows of the smallest doc_id are no copies; a struct with a null id is the largest
    first = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id"))
    kinds = each.groupBy("digest", "part", "fails", "is_good", "is_toxic").agg(F.sum("n").alias("total"), F.min(F.struct(first.alias("first"), "n")).alias("least"))
    texts = kinds.groupBy("digest", "fails").agg(
        F.min("least.first").alias("first"),
        F.collect_list(F.struct("part", "is_good", "is_toxic", F.col("total").alias("n"), "least")).alias("kinds"),  # parts times four, however many copies
    )
    one = texts.select("fails", "first", F.explode("kinds").alias("k")).select("fails", "k.*", F.when(F.col("k.least.first") == F.col("first"), F.col("k.least.n")).otherwise(0).alias("originals"))
    split = F.explode(F.array(F.struct(F.col("fails").alias("fails"), F.col("originals").alias("n")), F.struct((F.col("fails") + _BIT["E"]).alias("fails"), (F.col("n") - F.col("originals")).alias("n"))))
    return one.select("part", "is_good", "is_toxic", split.alias("s")).groupBy("part", "s.fails").agg(
        F.sum("s.n").alias("n"), F.sum(F.col("s.n") * F.col("is_good")).alias("good"), F.sum(F.col("s.n") * F.col("is_toxic")).alias("toxic")
    )


def lattice_edges(counts: DataFrame) -> DataFrame:
    """part, applied (bits of the subset), filter, and what happens on each of the 80 edges."""
    edges = F.array(*(F.struct(F.lit(s).alias("applied"), F.lit(f).alias("filter"), F.lit(b).alias("bit")) for s in range(32) for f, b in _BIT.items() if not s & b))
    rows = counts.select("part", "fails", *_COUNTS, F.explode(edges).alias("e")).select("part", "fails", *_COUNTS, "e.*")
    before, here = F.col("fails").bitwiseAND(F.col("applied")) != 0, F.col("fails").bitwiseAND(F.col("bit")) != 0
    total = lambda where, what="n": F.sum(F.when(where, F.col(what)).otherwise(0))
    return rows.groupBy("part", "applied", "filter").agg(
        total(~before & ~here).alias("kept"),
        total(~before & here).alias("removed"),
        total(before & here).alias("redundant"),
        total(F.col("fails") == F.col("bit")).alias("unique_fails"),
        total(~before & here, "good").alias("good_lost"),
        total(~before & here, "toxic").alias("toxic_lost"),
    )


def paths() -> list[tuple[str, int, int, str]]:
    """The 600 steps: order, step, subset applied before, filter."""
    return [("".join(p), k + 1, sum(_BIT[f] for f in p[:k]), p[k]) for p in permutations(FILTERS) for k in range(len(p))]


def filter_interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    steps = docs.sparkSession.createDataFrame(paths(), "filter_order string, step int, applied int, filter string")
    edges = lattice_edges(profiles(docs, labels))
    crossed = steps.groupBy("applied", "filter").agg(F.count("*").alias("orders"))  # 600 rows, a fixed number
    weighed = edges.join(F.broadcast(crossed), ["applied", "filter"])
    shapley = weighed.groupBy("part", "filter").agg(F.sum(F.col("removed") * F.col("orders")).alias("shapley"))
    return edges.join(shapley, ["part", "filter"]).join(F.broadcast(steps), ["applied", "filter"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )


#: The same in DuckDB, order by order: the first filter that a document fails removes it.
ORACLE = r"""
with d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text from documents),
w as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words, min(doc_id) over (partition by text) as first from d),
f as (select part, coalesce(l.quality = 1, false) as good, coalesce(l.toxic = 1, false) as toxic,
  (case when len(words) < 100 then 'A' else '' end) || (case when 100 * len(list_distinct(words)) < 80 * len(words) then 'B' else '' end)
  || (case when 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 10 * length(text) then 'C' else '' end)
  || (case when regexp_matches(text, '[#$%&*|]') then 'D' else '' end) || (case when w.doc_id > first then 'E' else '' end) as fails
  from w left join (select doc_id, max(quality) as quality, max(toxic) as toxic from labels group by doc_id) l using (doc_id)),
c as (select part, fails, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from f group by part, fails),
x as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
o as (select a.x || b.x || c.x || d.x || e.x as filter_order from x a, x b, x c, x d, x e
  where b.x <> a.x and c.x not in (a.x, b.x) and d.x not in (a.x, b.x, c.x) and e.x not in (a.x, b.x, c.x, d.x)),
s as (select filter_order, unnest(range(1, 6)) as step from o),
t as (select part, filter_order, step, filter_order[step] as f, n, good, toxic, fails, contains(fails, filter_order[step]) as here,
  exists (select 1 from x where contains(fails, x.x) and contains(filter_order[1:step - 1], x.x)) as before from c, s),
g as (select part, filter_order, step, f, coalesce(sum(n) filter (not before and not here), 0)::bigint as kept, coalesce(sum(n) filter (not before and here), 0)::bigint as removed,
  coalesce(sum(n) filter (before and here), 0)::bigint as redundant, coalesce(sum(n) filter (fails = f), 0)::bigint as unique_fails,
  coalesce(sum(good) filter (not before and here), 0)::bigint as good_lost, coalesce(sum(toxic) filter (not before and here), 0)::bigint as toxic_lost from t group by all)
select part, filter_order, step::int as step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) over (partition by part, f)::bigint as shapley from g
"""
