"""Detection in columns: all rules, their checks and recognised entities over one segment, in the JVM only.

A text is tried by the rules whose marks it holds; each of those that matches gives its matches, values and gaps, and
one expression over all of them works out positions. Works on columns and on elements of arrays alike.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskloom.functions import categories as C
from maskloom.functions import native as N
from maskloom.functions import rules as R
from maskloom.functions import words as W

ENTITIES = "array<struct<start:int,stop:int,type:string>>"
TAGGED = "array<struct<start:int,neg_stop:int,ord:int,category:string,priority:int>>"
_HITS = "struct<ord:int,cut:array<string>>"
_CHECKED = {k: r.check for r, k in zip((*R.RULES, R.DATES), range(99), strict=False) if r.check}


@dataclass(frozen=True)
class Options:
    """``hide_names``, ``hide_locations`` and ``hide_orgs`` gate recognised entities only: rules always apply.

    ``hide_dates`` gates the date rule. ``smart_contract``: lines between the subject of a contract and its
    details stay as they are. ``spread``: terms found by the recogniser are masked wherever they occur.
    ``numbered``: labels have numbers; without them they are bare categories, which can't be restored.
    """

    hide_names: bool = True
    hide_locations: bool = True
    hide_orgs: bool = True
    hide_dates: bool = False
    smart_contract: bool = False
    spread: bool = True
    numbered: bool = True

    def as_map(self) -> dict[str, bool]:
        return dict(self.__dict__)


# --- checks: (value, 40 characters before it) to the (skipped at the start, kept length), null to reject -----------


def _all_of(value: Column) -> Column:
    return F.struct(F.lit(0).alias("skip"), F.length(value).alias("keep"))


def _core(value: Column, word: str, between: str) -> Column:
    """The value without words of a kind at either end; null if it has no others."""
    none = value.rlike(rf"^{word}(?:{between}{word})*+$")
    lead = F.length(F.regexp_extract(value, rf"^(?:{word}{between})*+", 0))
    trail = F.length(F.regexp_extract(value, rf"(?:{between}{word})*+$", 0))
    return F.when(~none, F.struct(lead.alias("skip"), (F.length(value) - lead - trail).alias("keep")))


def _caps_name(value: Column, before: Column) -> Column:
    """Words in capitals are a person only if one has the ending of a name; roles at either end stay outside."""
    return N.let(_core(value, W.NAMELESS_WORD, r"[\s-]+"), lambda c: F.when(F.substring(value, c["skip"] + 1, c["keep"]).rlike(W.NAME_WORD), c))


def _latin_org(value: Column, before: Column) -> Column:
    """Latin words are a company if a legal form is among them; else stop words are cut off, and short single words dropped."""
    formed = value.rlike(r"\s") & value.rlike(rf"(?i)(?<![A-Za-z0-9&-])(?:{'|'.join(W.LATIN_FORMS)})(?![A-Za-z0-9&-])")
    core = N.let(_core(value, W.LATIN_WORD, r"(?:\s+&)?\s+"), lambda c: F.when((c["keep"] > 3) | F.substring(value, c["skip"] + 1, c["keep"]).rlike(r"\s"), c))
    return F.when(formed, _all_of(value)).otherwise(core)


def _not_zero(value: Column, before: Column) -> Column:
    return F.when(value.rlike("[1-9]"), _all_of(value))


_NORM_BEFORE = r"(?Uiu)(?:\b(?:ст|п|пп|ч|гл|стат\w*|пункт\w*|част\w*|глав\w*|раздел\w*|гост|ту|снип|сп|iso|верси\w*)\b)[\s.№Р]*(?:[\d.,\-\s]|и\s){0,20}$"
_INNER_BEFORE = r"(?Uiu)\b(?:приложени\w*|пункт\w*|стат\w*|раздел\w*|дополнительн\w*\s+соглашени\w*|глав\w*|таблиц\w*|рисун\w*|лист\w*|стр|п|ст)\.?\s*№?\s*$"


def _plain_money(value: Column, before: Column) -> Column:
    """A bare decimal is an amount unless it is zero or stands behind a reference to a norm or clause."""
    return F.when(value.rlike("[1-9]") & ~before.rlike(_NORM_BEFORE), _all_of(value))


def _document_number(value: Column, before: Column) -> Column:
    """A number of one or two digits behind an appendix or clause is a reference inside the document."""
    return F.when(~(value.rlike(r"(?U)^\d{1,2}$") & before.rlike(_INNER_BEFORE)), _all_of(value))


CHECKS = {"caps_name": _caps_name, "latin_org": _latin_org, "not_zero": _not_zero, "plain_money": _plain_money, "document_number": _document_number}


# --- rules -------------------------------------------------------------------------------------


def _hits(text: Column, rule: R.Rule, order: int, sep: Column) -> Column:
    """ord and the text cut at the matches of a rule; a single piece where it doesn't match."""
    return F.struct(F.lit(order).alias("ord"), N.cut(text, rule.pattern, rule.group, sep).alias("cut"))


def rule_rows(text: Column, dates: bool = False, rules: tuple[R.Rule, ...] | None = None) -> Column:
    """Array of (ord, start, stop, value) of all rules that match, before overlaps are united. ``ord``: place in the registry."""
    chosen = [(r, R.ORDER[r.name]) for r in (rules or ((*R.RULES, R.DATES) if dates else R.RULES))]
    by_needs: dict[str, list] = {}
    for rule, order in chosen:
        by_needs.setdefault(rule.needs, []).append((rule, order))
    none = F.array().cast(f"array<{_HITS}>")

    def tried(sep: Column) -> Column:
        out = []
        for needs, rules in by_needs.items():
            gate = F.lit(True)
            for mark in needs:
                gate = gate & text.rlike(R.MARKS[mark])
            out.append(F.when(gate, F.array(*(_hits(text, r, o, sep) for r, o in rules)).cast(f"array<{_HITS}>")).otherwise(none))
        return F.filter(F.concat(*out), lambda h: F.size(h["cut"]) > 1)

    starts = [o for r, o in chosen if r.place == "start"]
    inside = [o for r, o in chosen if r.place == "inside"]

    def positions(x: Column) -> Column:
        # gap, match, group of each match
        at = F.sequence(F.lit(0), F.size(x["cut"]) - 2, F.lit(3))
        ends = N.running(F.transform(at, lambda k: F.length(F.get(x["cut"], k)) + F.length(F.get(x["cut"], k + 1))), lambda a, b: a + b)
        m, v = F.transform(at, lambda k: F.get(x["cut"], k + 1)), F.transform(at, lambda k: F.get(x["cut"], k + 2))
        here = F.struct(x["ord"].alias("ord"), m.alias("m"), v.alias("v"), ends.alias("ends"))

        def one(y: Column, m: Column, i: Column) -> Column:
            v, end = F.get(y["v"], i), F.get(y["ends"], i)
            start = F.when(y["ord"].isin(starts), end - F.length(m)).when(y["ord"].isin(inside), end - F.length(m) + F.length(F.regexp_extract(m, r"(?U)^\(\s*", 0))).otherwise(end - F.length(v))
            return N.let(F.struct(start.alias("start"), v.alias("v")), lambda z: checked(y["ord"], z["start"], z["v"]))

        return N.let(here, lambda y: F.transform(y["m"], lambda m, i: one(y, m, i)))

    def applied(check):
        return lambda z: check(z["v"], z["b"])

    def checked(order: Column, start: Column, value: Column) -> Column:
        before = F.substring(text, F.greatest(start - 39, F.lit(1)), F.least(start, F.lit(40)))
        kept = F.when(F.lit(False), _all_of(value))
        for name, check in CHECKS.items():
            if orders := [o for r, o in chosen if r.check == name]:
                kept = kept.when(order.isin(orders), N.let(F.struct(value.alias("v"), before.alias("b")), applied(check)))
        kept = kept.otherwise(_all_of(value)) if _CHECKED else _all_of(value)
        row = lambda k: F.struct(order.alias("ord"), (start + k["skip"]).alias("start"), (start + k["skip"] + k["keep"]).alias("stop"), F.substring(value, k["skip"] + 1, k["keep"]).alias("value"))
        return N.let(kept, lambda k: F.when(k.isNotNull(), row(k)))

    hits = N.let(N.separator(text), tried)
    found = N.let(hits, lambda h: F.flatten(F.transform(h, lambda x: N.let(x, positions))))
    return F.filter(found, lambda s: s.isNotNull() & s["value"].rlike(r"(?U)\S"))


def rule_spans(text: Column, options: Options = Options()) -> Column:
    """Tagged spans of all rules (see ``native.merged``)."""
    names = [r.category for r in (*R.RULES, R.DATES)]
    categories = F.array(*map(F.lit, names))
    priorities = F.array(*(F.lit(C.PRIORITY[c]) for c in names))
    tag = lambda s: F.struct(s["start"].alias("start"), (-s["stop"]).alias("neg_stop"), s["ord"].alias("ord"), F.get(categories, s["ord"]).alias("category"), F.get(priorities, s["ord"]).alias("priority"))
    return F.transform(rule_rows(text, options.hide_dates), tag).cast(TAGGED)


# --- entities ----------------------------------------------------------------------------------


def recognised(text: Column) -> Column:
    """Entities of a small recogniser by endings and triggers: people (PER) and places (LOC)."""
    people = F.transform(N.match_spans(text, R.PEOPLE), lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), F.lit("PER").alias("type")))
    places = F.transform(N.match_spans(text, R.PLACES, 1), lambda s: F.struct((s["stop"] - F.length(s["value"])).alias("start"), s["stop"].alias("stop"), F.lit("LOC").alias("type")))
    return F.when(text.rlike(R.MARKS["я"]), F.concat(people, places)).otherwise(F.array()).cast(ENTITIES)


def can_be_name(value: Column) -> Column:
    """Whether what a recogniser found can be a name at all: not roles, bodies or words of contracts only."""
    word = rf"(?:{W.ROLE_WORD}|{W.INSTITUTION_WORD}|{W.LATIN_WORD})"
    return value.rlike("[A-Za-zА-Яа-яЁё]") & ~value.rlike(rf"(?U)^\W*{word}(?:[^A-Za-zА-Яа-яЁё]+{word})*+\W*$")


def is_country(value: Column) -> Column:
    """A place made of nothing but words for the country is a reference to its law, not an address."""
    return value.rlike(rf"(?U)^\W*{W.COUNTRY_WORD}(?:\W+{W.COUNTRY_WORD})*+\W*$")


def entity_rows(text: Column, entities: Column, options: Options = Options()) -> Column:
    """Array of (start, stop, category, value) of the entities that may be hidden."""
    kinds = {"PER": C.PERSON if options.hide_names else None, "LOC": C.ADDRESS if options.hide_locations else None, "ORG": C.ORG if options.hide_orgs else None}
    with_value = F.transform(entities, lambda e: F.struct(e["start"].alias("start"), e["stop"].alias("stop"), e["type"].alias("type"), F.substring(text, e["start"] + 1, e["stop"] - e["start"]).alias("value")))
    category = lambda t: F.when(t == "PER", F.lit(kinds["PER"])).when(t == "LOC", F.lit(kinds["LOC"])).when(t == "ORG", F.lit(kinds["ORG"]))
    rows = F.transform(with_value, lambda e: F.struct(e["start"].alias("start"), e["stop"].alias("stop"), category(e["type"]).alias("category"), e["value"].alias("value"), e["type"].alias("type")))
    return F.filter(rows, lambda e: e["category"].isNotNull() & can_be_name(e["value"]) & ~((e["type"] == "LOC") & is_country(e["value"])))


def tagged_entities(rows: Column, order: int = -1) -> Column:
    priorities = F.create_map(*(x for k, v in C.PRIORITY.items() for x in (F.lit(k), F.lit(v))))
    return F.transform(rows, lambda e: F.struct(e["start"].alias("start"), (-e["stop"]).alias("neg_stop"), F.lit(order).alias("ord"), e["category"].alias("category"), priorities[e["category"]].alias("priority"))).cast(TAGGED)
