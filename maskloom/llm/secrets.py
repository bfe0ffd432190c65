"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Three kinds of base spans are found in each whole text, leftmost and without overlap within a kind:
``assign``, ``access`` and ``hex``; matches that fail their kind's least length are dropped. The value of
a candidate (group 2 of assign, the whole match of the others, and bare ``token`` candidates: 20 or more
of ``[A-Za-z0-9_-]`` with a letter and a digit) is hashed, and the hashes are aggregated over the corpus
by distinct owners and repositories. A value that ``copied`` or more owners or twice as many
repositories hold is a widely copied example; any other is live. Base spans stay whatever their class.
The method adds a span ``token`` for each bare token that overlaps no base span of its document and whose
value one owner alone holds. The table has one column for where a document comes from: the owner is
``source``, the repository is ``source`` with ``lang``.

Positions are code points, the end is exclusive. Work on a text with n matches is near n to the power 1.5.

Cases: a null text is an empty one, without spans, whose base_sha256 is that of the empty string; a null
source or language counts as one owner or language of its own, the empty name; rows that repeat have a
row each and count once as owners; a null doc_id is kept. Other columns are ignored. Only spans, never
texts, are shuffled; counts per value are summed before the shuffle, the few values that very many
documents share are joined back by a broadcast of bounded size, and rows without candidates take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskloom.functions.native import let, running
from maskloom.llm.common import checkpointed

#: Kinds in their order, patterns, least lengths.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
TOKEN = r"[A-Za-z0-9_-]{20,}"
KINDS = ("assign", "access", "hex", "token")
LEAST = {"assign": 6, "access": 20, "hex": 24, "token": 20}

_KEY = r"(?i:password|passwd|secret|token|api_?key)"
_ASSIGN = ASSIGN.replace("(password|passwd|secret|token|api_?key)", _KEY).replace("([A-Za-z0-9+/_.=-]+)", "[A-Za-z0-9+/_.=-]+")
_PREFIX = "^" + _ASSIGN.replace("[A-Za-z0-9+/_.=-]+", "")
#: Runs of the same characters that reach the least length give the same spans as dropping short matches.
_ACCESS_LONG, _HEX_LONG = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"
_SPAN = "array<struct<start:bigint,kind:int,end:bigint,value:string>>"


def _with_value(spans: Column, value) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), value(s["value"]).alias("value")))


def spans_of(text: Column) -> Column:
    """All candidates of a text, in no particular order; ``value`` is the secret itself. One expression works out the
    positions of all kinds: a match ends behind the gaps and matches up to it."""
    patterns = (_ASSIGN, _ACCESS_LONG, _HEX_LONG, TOKEN)
    hits = F.array_compact(F.array(*(
        F.when(text.rlike(p), F.struct(F.lit(k).alias("kind"), F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias("m"), F.split(text, p, -1).alias("gaps"))) for k, p in enumerate(patterns)
    )))

    def positions(x: Column) -> Column:
        ends = running(F.transform(x["m"], lambda m, i: F.length(F.get(x["gaps"], i)) + F.length(m)), lambda a, b: a + b)
        value = lambda m: F.when(x["kind"] == 0, F.regexp_replace(m, _PREFIX, "")).otherwise(m)
        span = lambda m, end: F.struct((end - F.length(m)).cast("long").alias("start"), x["kind"].alias("kind"), end.cast("long").alias("end"), value(m).alias("value"))
        return let(F.struct(x["m"].alias("m"), ends.alias("ends")), lambda y: F.transform(y["m"], lambda m, i: span(m, F.get(y["ends"], i))))

    found = F.flatten(F.transform(hits, lambda h: let(h, positions)))
    long_enough = lambda s: (s["kind"] != 0) | (F.length(s["value"]) >= LEAST["assign"])
    mixed = lambda s: (s["kind"] != 3) | s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]")
    return F.filter(found, lambda s: long_enough(s) & mixed(s)).cast(_SPAN)


def _joined(spans: Column) -> Column:
    """kind:start:end by start, then kind."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _of(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def _candidates(docs: DataFrame) -> tuple[Column, Column, Column]:
    """Owner, language and hashed candidates of a row; the secrets themselves are not written anywhere."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return name("source"), name("lang"), _with_value(spans_of(text), lambda v: F.sha2(v, 256))


def _base_and_bare(found: Column) -> tuple[Column, Column]:
    """Base spans, and tokens that touch none of them: those that do are part of them. In the order of starts, a token touches a
    base span before it that reaches over its start, or one behind it that starts before its end."""

    def apart(x: Column) -> Column:
        reach = running(F.transform(x["s"], lambda s: F.when(s["kind"] < 3, s["end"]).otherwise(0)), F.greatest)
        ahead = F.reverse(running(F.transform(F.reverse(x["s"]), lambda s: F.when(s["kind"] < 3, s["start"]).otherwise(2**31 - 1)), F.least))
        here = F.struct(x["s"].alias("s"), reach.alias("reach"), ahead.alias("ahead"))
        return let(here, lambda y: F.filter(y["s"], lambda s, i: (s["kind"] == 3) & (F.get(y["reach"], i) <= s["start"]) & (F.get(y["ahead"], i) >= s["end"])))

    bare = F.when(F.exists(found, lambda s: s["kind"] == 3), let(F.struct(F.array_sort(found).alias("s")), apart)).otherwise(F.array()).cast(_SPAN)
    return F.filter(found, lambda s: s["kind"] < 3), bare


def _found(docs: DataFrame) -> DataFrame:
    """doc_id, owner, lang, base, bare and a key, null where nothing was found; rows that repeat have one key."""
    owner, lang, spans = _candidates(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), owner.alias("owner"), lang.alias("lang"), spans.alias("found"))
    return checkpointed(_split(rows)).withColumn("key", _key())


def _split(rows: DataFrame) -> DataFrame:
    """``found`` as base and bare. Explode over one row keeps both from being worked out again wherever they are named."""
    kept = [c for c in rows.columns if c != "found"]
    once = rows.select(*kept, F.explode(F.array("found")).alias("found"))
    base, bare = _base_and_bare(F.col("found"))
    return once.select(*kept, F.explode(F.array(F.struct(base.alias("base"), bare.alias("bare")))).alias("b")).select(*kept, "b.base", "b.bare")


def _key() -> Column:
    """256 bits of all that was found in a row and of where it is from: rows with one key have the same spans to the end."""
    return F.when((F.size("base") > 0) | (F.size("bare") > 0), F.sha2(F.to_json(F.struct("doc_id", "owner", "lang", "base", "bare")), 256))


def _classified(rows: DataFrame, copied: int, share: int = 1000) -> DataFrame:
    """key, s (span), owners and example for every candidate in the corpus.

    Fewer than ``share`` values can hold more than a ``share``-th of all candidates each: those are joined back by a
    broadcast, so that a value that very many documents share lands in no task of its own.
    """
    each = rows.where("key is not null").select("key", "owner", "lang", F.explode(F.concat("base", "bare")).alias("s"))
    held = each.groupBy(F.col("s.value").alias("value"), "owner", "lang").agg(F.count("*").alias("n"))
    # two steps: by value and owner, then by value, so that counts are summed before each shuffle
    owners = held.groupBy("value", "owner").agg(F.count("*").alias("repositories"), F.sum("n").alias("n")).groupBy("value").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"), F.sum("n").alias("n"))
    example = (F.col("owners") >= copied) | (F.col("repositories") >= 2 * copied)
    owners = checkpointed(owners.select("value", "owners", example.alias("example"), "n"))
    total = owners.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = owners.where(F.col("n") * share > total).drop("n")
    rest = owners.where(F.col("n") * share <= total).drop("n")
    each = each.select("key", "s", F.col("s.value").alias("value")).join(F.broadcast(hot), "value", "left")
    found = ("key", "s", "value", "owners", "example")
    return each.where("owners is not null").select(*found).unionByName(each.where("owners is null").select("key", "s", "value").join(rest, "value").select(*found))


def secret_scan(docs: DataFrame, copied: int = 3) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example."""
    rows = _found(docs)
    none = F.array().cast(_SPAN)
    by_row = _classified(rows, copied).groupBy("key").agg(
        F.collect_set(F.when((F.col("s.kind") == 3) & (F.col("owners") == 1), F.col("s"))).alias("added"),
        F.count_distinct(F.when(~F.col("example"), F.col("value"))).alias("n_live"),
        F.count_distinct(F.when(F.col("example"), F.col("value"))).alias("n_example"),
    )
    base = ("doc_id", "base")
    touched = rows.where("key is not null").join(by_row, "key").select(*base, "added", "n_live", "n_example")
    plain = rows.where("key is null").select(*base, none.alias("added"), F.lit(0).cast("long").alias("n_live"), F.lit(0).cast("long").alias("n_example"))
    return touched.unionByName(plain).select(
        "doc_id",
        _of(F.col("base"), 0).alias("n_assign"),
        _of(F.col("base"), 1).alias("n_access"),
        _of(F.col("base"), 2).alias("n_hex"),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.concat(F.col("base"), F.col("added"))).alias("spans"),
        "n_live",
        "n_example",
    )


def _without(text: Column, spans: Column, mask: str) -> Column:
    """The text with the united spans (sorted by start) replaced by ``mask``."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        before = F.substring(text, (state["at"] + 1).cast("int"), F.greatest(s["start"] - state["at"], F.lit(0)).cast("int"))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(s["start"] >= state["at"], F.concat(state["out"], before, F.lit(mask))).otherwise(state["out"]).alias("out"))

    return F.aggregate(spans, start, step, lambda s: F.concat(s["out"], F.substring(text, (s["at"] + 1).cast("int"), F.length(text))))


def secrets_masked(docs: DataFrame, copied: int = 3, mask: str = "[SECRET]") -> DataFrame:
    """The rows of ``docs`` with live secrets masked in ``text`` (and ``n_chars`` counted anew); columns as in ``docs``.

    Live are base spans that are no widely copied examples, and the tokens that one owner alone holds.
    Rows without candidates pass without a shuffle; the others are scanned again rather than kept.
    """
    rows = _found(docs)
    hide = _classified(rows, copied).where("not example and (s.kind < 3 or owners = 1)").groupBy("key").agg(F.array_sort(F.collect_set(F.struct("s.start", "s.end"))).alias("hide"))
    owner, lang, spans = _candidates(docs)
    named = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), owner.alias("owner"), lang.alias("lang"), spans.alias("found"))
    named = _split(named)
    any_ = (F.size("base") > 0) | (F.size("bare") > 0)
    new = _without(F.col("row.text"), F.col("hide"), mask)
    changed = named.where(any_).withColumn("key", _key()).join(hide, "key", "left")
    put = {"text": new, "n_chars": F.length(new).cast("long")}
    out = [F.when(F.col("hide").isNull(), F.col("row")[c]).otherwise(put[c]).alias(c) if c in put else F.col("row")[c].alias(c) for c in docs.columns]
    return named.where(~any_).select("row.*").unionByName(changed.select(*out))


#: The same in DuckDB: a match starts behind all gaps and matches before it.
def _duck(kind: int, pattern: str, value: str, where: str) -> str:
    return f"""
  select n, doc_id, owner, lang, {kind} as kind, st as "start", st + length(m) as "end", {value} as value from (
    select n, doc_id, owner, lang, ms[i] as m, list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda g: length(g))), 0) as st
    from (select *, unnest(generate_series(1, len(ms))) as i from (
      select n, doc_id, owner, lang, regexp_extract_all(text, '{pattern}', 0) as ms, string_split_regex(text, '{pattern}') as gaps from d where regexp_matches(text, '{pattern}'))))
  where {where}"""


def _quoted(p: str) -> str:
    return p.replace("'", "''")


ORACLE = f"""
with d as (select row_number() over () as n, doc_id, coalesce(text, '') as text, coalesce(source, '') as owner, coalesce(lang, '') as lang from documents),
s as (
  {" union all ".join((
    _duck(0, _quoted(_ASSIGN), f"regexp_replace(m, '{_quoted(_PREFIX)}', '')", "length(value) >= 6"),
    _duck(1, _ACCESS_LONG, "m", "true"), _duck(2, _HEX_LONG, "m", "true"),
    _duck(3, TOKEN, "m", "regexp_matches(m, '[0-9]') and regexp_matches(m, '[A-Za-z]')")))}
),
u as (select * from s where kind < 3 or not exists (select 1 from s b where b.n = s.n and b.kind < 3 and b."start" < s."end" and s."start" < b."end")),
o as (select value, count(distinct owner) as owners, count(distinct owner || chr(0) || lang) as repos from u group by value),
c as (select u.*, o.owners, (o.owners >= 3 or o.repos >= 6) as example, ['assign', 'access', 'hex', 'token'][kind + 1] || ':' || "start" || ':' || "end" as said from u join o using (value)),
r as (select n, count(*) filter (kind = 0) as n_assign, count(*) filter (kind = 1) as n_access, count(*) filter (kind = 2) as n_hex,
  coalesce(string_agg(said, ',' order by "start", kind) filter (kind < 3), '') as base,
  coalesce(string_agg(said, ',' order by "start", kind) filter (kind < 3 or owners = 1), '') as spans,
  count(distinct value) filter (not example) as n_live, count(distinct value) filter (example) as n_example from c group by n)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_live, 0) as n_live, coalesce(n_example, 0) as n_example
from d left join r using (n)
"""
