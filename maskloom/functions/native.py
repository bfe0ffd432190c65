"""Column expressions: all matches of a pattern with their positions, and rules without look-around.

Spark has no function for positions of matches. ``split`` gives the gaps and ``regexp_extract_all`` the
matches; a match starts behind all gaps and matches before it. Positions are code points, half open. The
patterns here keep to what Java and RE2 read alike, so that DuckDB can check them.
"""

from __future__ import annotations

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

from maskloom.functions import categories as C

SPAN = "array<struct<start:int,stop:int,value:string,before:string,after:string>>"
MERGED = "array<struct<start:int,stop:int,category:string,value:string>>"
NUMBERED = "array<struct<start:int,stop:int,category:string,n:int,value:string>>"

# Patterns of the language-neutral rules.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
PHONE = r"\([0-9]{3,5}\)[ -]?[0-9]{1,3}[ -]?[0-9]{2}[ -]?[0-9]{2}"
DIGITS = r"[0-9]+"
DECIMAL = r"[0-9]+[.,][0-9]{2}"
LATIN = r"[A-Z][A-Za-z0-9&-]*( [A-Z][A-Za-z0-9&-]*)*"

#: The same for Java: no repeat of the last group is given back, and so none takes a level of the stack.
EMAIL_ONCE = EMAIL + "+"

#: Runs of digits that stand alone, by length.
DIGIT_IDS = {6: C.INDEX, 10: C.INN_COMPANY, 11: C.DOC_NO, 12: C.INN_PERSON, 13: C.OGRN, 14: C.DOC_NO, 15: C.OGRN, 20: C.ACCOUNT}


_BUILT: dict = {}


def built(key: tuple, make) -> Column:
    """The column that ``make`` gives, made once for each JVM and key: long expressions take seconds to put together."""
    key = (id(SparkContext._gateway), *key)
    if key not in _BUILT:
        _BUILT[key] = make()
    return _BUILT[key]


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def chunk_size(n: Column) -> Column:
    """Length of the pieces that keep work on n elements near n to the power 1.5, as Spark's arrays are copied to be appended to."""
    return F.greatest(F.lit(8), F.ceil(F.sqrt(n)).cast("int"))


def running(values: Column, op) -> Column:
    """For an array of ints: ``op`` (associative, as + or the greater) over all elements up to each. In pieces, so that no long array grows."""
    ints = lambda a: a.cast("array<int>")
    grow = lambda done, v: F.concat(done, F.array(F.when(F.size(done) == 0, v).otherwise(op(F.try_element_at(done, F.lit(-1)), v))))
    scan = lambda xs: F.aggregate(xs, ints(F.array()), lambda done, v: ints(grow(done, v)))

    def pieces(x: Column) -> Column:
        size = chunk_size(F.size(x["v"]))
        starts = F.sequence(F.lit(1), F.greatest(F.size(x["v"]), F.lit(1)), size)
        return F.struct(F.transform(starts, lambda k: scan(F.slice(x["v"], k, size))).alias("own"))

    def joined(x: Column) -> Column:
        before = scan(F.transform(x["own"], lambda own: F.try_element_at(own, F.lit(-1))))
        with_before = F.struct(x["own"].alias("own"), before.alias("before"))
        return let(with_before, lambda y: F.flatten(F.transform(y["own"], lambda own, k: F.when(k == 0, own).otherwise(F.transform(own, lambda v: op(F.get(y["before"], k - 1), v))))))

    return F.when(F.size(values) == 0, ints(F.array())).otherwise(let(let(F.struct(ints(values).alias("v")), pieces), joined))


def islands(rows: Column, opens) -> Column:
    """Array of (at, to): index of the first row of each group and of the one behind its last. ``opens(rows, i)``: row i starts a group."""
    first = let(rows, lambda r: F.filter(F.sequence(F.lit(0), F.size(r) - 1), lambda i: (i == 0) | opens(r, i)))
    ends = let(F.struct(rows.alias("r"), first.alias("f")), lambda x: F.transform(x["f"], lambda at, k: F.struct(at.alias("at"), F.coalesce(F.get(x["f"], k + 1), F.size(x["r"])).alias("to"))))
    return F.when(F.size(rows) == 0, F.array().cast("array<struct<at:int,to:int>>")).otherwise(ends)


def groups(rows: Column, opens, body) -> Column:
    """``body(rows of the group, k)`` for each group of neighbouring rows."""
    return let(rows, lambda r: let(F.struct(r.alias("r"), islands(r, opens).alias("i")), lambda x: F.transform(x["i"], lambda g, k: body(F.slice(x["r"], g["at"] + 1, g["to"] - g["at"]), k))))


#: Where a text is cut at its matches: a code point that is no character.
_CUT = "\uFDD0"


def separator(text: Column) -> Column:
    """A string that ``text`` does not hold: a code point that is no character, or, where it has that one, its own digest between two."""
    return F.when(text.contains(_CUT), F.concat(F.lit(_CUT), F.sha2(text, 256), F.lit(_CUT))).otherwise(F.lit(_CUT))


def cut(text: Column, pattern: str, group: int, sep: Column) -> Column:
    """A text cut at the matches (never empty) of a pattern: gap, match, its group, gap, match, its group and so on to the last gap. One
    pass: matches are set apart by ``sep`` (see ``separator``), at which the text is split. (``split`` at a long pattern puts the pattern together for each text.)"""
    return F.split(F.regexp_replace(text, F.lit(pattern), F.concat(sep, F.lit("$0"), sep, F.lit(f"${group}"), sep)), sep, -1)


def gaps(text: Column, pattern: str) -> Column:
    """What lies between the matches (never empty) of a pattern."""
    return F.split(F.regexp_replace(text, F.lit(pattern), separator(text)), separator(text), -1)


def match_spans(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches (never empty) with start, stop, value and the character on either side ('' at the ends).

    With ``group`` the value is that group of the match; start and stop stay those of the whole match."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else matches

    def spans(x: Column) -> Column:
        at = F.transform(x["m"], lambda m, i: F.length(F.get(x["gaps"], i)) + F.length(m))
        here = F.struct(x["m"].alias("m"), x["v"].alias("v"), x["gaps"].alias("gaps"), running(at, lambda a, b: a + b).alias("stops"))
        return let(
            here,
            lambda y: F.transform(
                y["m"],
                lambda m, i: F.struct(
                    (F.get(y["stops"], i) - F.length(m)).alias("start"), F.get(y["stops"], i).alias("stop"), F.get(y["v"], i).alias("value"),
                    F.right(F.get(y["gaps"], i), F.lit(1)).alias("before"), F.left(F.get(y["gaps"], i + 1), F.lit(1)).alias("after"),
                ),
            ),
        )

    found = let(F.struct(matches.alias("m"), values.alias("v"), gaps(text, pattern).alias("gaps")), spans)
    return F.when(text.rlike(pattern), found.cast(SPAN)).otherwise(F.array().cast(SPAN))


def stands_alone(s: Column) -> Column:
    """No letter, digit, underscore or hyphen on either side."""
    return ~s["before"].rlike("[A-Za-z0-9_-]") & ~s["after"].rlike("[A-Za-z0-9_-]")


def tagged(spans: Column, category: str | Column, order: int) -> Column:
    """(start, neg_stop, ord, category, priority) in the order in which overlaps are resolved."""
    priorities = F.create_map(*(x for k, v in C.PRIORITY.items() for x in (F.lit(k), F.lit(v))))

    def one(s: Column) -> Column:
        name = F.lit(category) if isinstance(category, str) else category(s)
        return F.struct(s["start"].alias("start"), (-s["stop"]).alias("neg_stop"), F.lit(order).alias("ord"), name.alias("category"), priorities[name].alias("priority"))

    return F.transform(spans, one)


def neutral_spans(text: Column) -> Column:
    """E-mails, bracketed phones and bare digit identifiers, tagged, in no order."""
    lengths = F.create_map(*(x for k, v in DIGIT_IDS.items() for x in (F.lit(k), F.lit(v))))
    known = lambda s: lengths[F.length(s["value"])]
    ids = F.filter(match_spans(text, DIGITS), lambda s: stands_alone(s) & known(s).isNotNull())
    return F.concat(tagged(match_spans(text, EMAIL_ONCE), C.EMAIL, 40), tagged(match_spans(text, PHONE), C.PHONE, 41), tagged(ids, known, 50))


def merged(spans: Column, text: Column) -> Column:
    """Overlapping spans united, in order: (start, stop, category, value). Touching spans stay apart; a category gives way only to a strictly higher priority."""
    order = F.array_sort(spans)

    def united(x: Column) -> Column:
        apart = lambda r, i: F.get(r, i)["start"] >= F.get(r, i)["reach"]
        with_reach = F.transform(x["s"], lambda s, i: F.struct(s["start"].alias("start"), (-s["neg_stop"]).alias("stop"), s["category"].alias("category"), s["priority"].alias("priority"), F.get(x["reach"], i - 1).alias("reach")))
        best = lambda own: F.aggregate(own, F.get(own, F.lit(0)), lambda a, b: F.when(b["priority"] > a["priority"], b).otherwise(a))
        return groups(with_reach, apart, lambda own, _: F.struct(F.get(own, F.lit(0))["start"].cast("int").alias("start"), F.array_max(F.transform(own, lambda s: s["stop"])).cast("int").alias("stop"), best(own)["category"].alias("category")))

    found = let(order, lambda s: let(F.struct(s.alias("s"), running(F.transform(s, lambda x: -x["neg_stop"]), F.greatest).alias("reach")), united))
    put = F.transform(between(text, found), lambda p: F.struct(p["start"].alias("start"), p["stop"].alias("stop"), p["category"].alias("category"), p["value"].alias("value")))
    return F.when(F.size(spans) == 0, F.array().cast(MERGED)).otherwise(put.cast(MERGED))


def between(text: Column, spans: Column) -> Column:
    """Disjoint sorted spans with ``value`` and ``gap``, the text since the span before. The text is cut into pieces of
    many spans first, since a substring is searched for from the beginning of its string."""

    def cut(x: Column) -> Column:
        size = chunk_size(F.size(x["s"]))
        opens = lambda r, i: i % size == 0

        def piece(own: Column, k: Column) -> Column:
            from_ = F.coalesce(F.get(x["s"], k * size - 1)["stop"], F.lit(0))
            part = F.substring(x["t"], from_ + 1, F.element_at(own, -1)["stop"] - from_)
            here = F.struct(own.alias("own"), from_.alias("from"), part.alias("part"))
            before = lambda p, i: F.when(i == 0, p["from"]).otherwise(F.get(p["own"], i - 1)["stop"])
            take = lambda p, a, z: F.substring(p["part"], a - p["from"] + 1, z - a)
            return let(here, lambda p: F.transform(p["own"], lambda s, i: s.withField("value", take(p, s["start"], s["stop"])).withField("gap", take(p, before(p, i), s["start"]))))

        return F.flatten(groups(x["s"], opens, piece))

    return let(F.struct(text.alias("t"), spans.alias("s")), cut)


def numbered(spans: Column) -> Column:
    """Merged spans with n: the order of first appearance of the value within its category."""
    key = lambda s: F.struct(s["category"], s["value"])
    by_value = F.array_sort(F.transform(spans, lambda s: F.struct(s["category"].alias("category"), s["value"].alias("value"), s["start"].alias("start"), s["stop"].alias("stop"))))
    values = groups(by_value, lambda r, i: key(F.get(r, i)) != key(F.get(r, i - 1)), lambda own, _: F.struct(F.get(own, F.lit(0))["category"].alias("category"), F.get(own, F.lit(0))["start"].alias("first"), own.alias("own")))
    row = lambda s, n: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["category"].alias("category"), (n + 1).cast("int").alias("n"), s["value"].alias("value"))
    by_category = groups(F.array_sort(values), lambda r, i: F.get(r, i)["category"] != F.get(r, i - 1)["category"], lambda own, _: F.flatten(F.transform(own, lambda v, n: F.transform(v["own"], lambda s: row(s, n)))))
    return F.when(F.size(spans) == 0, F.array().cast(NUMBERED)).otherwise(F.array_sort(F.flatten(by_category)).cast(NUMBERED))


def label(category: Column, n: Column) -> Column:
    return F.concat(F.lit("["), category, F.lit("_"), n.cast("string"), F.lit("]"))


def spliced(text: Column, spans: Column, by) -> Column:
    """The text with each of the disjoint, sorted spans replaced by ``by(span)``."""
    rest = F.substring(text, F.element_at(spans, -1)["stop"] + 1, F.length(text))
    out = F.concat(F.array_join(F.transform(between(text, spans), lambda s: F.concat(s["gap"], F.coalesce(by(s), F.lit("")))), ""), rest)
    return F.when(F.size(spans) == 0, text).otherwise(out)


def replaced(text: Column, pattern: str, by) -> Column:
    """The text with match m, the i-th from 0, replaced by ``by(m, i)``; matches and gaps are put together in order."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    joined = let(F.struct(gaps(text, pattern).alias("g"), matches.alias("m")), lambda x: F.array_join(F.transform(x["g"], lambda g, i: F.concat(g, F.coalesce(by(F.get(x["m"], i), i), F.lit("")))), ""))
    return F.when(text.rlike(pattern), joined).otherwise(text)
