"""Markdown blocks: normal forms for alignment, escapes, inline rendering, list numbers, tables, notes."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

# Signs that count as one another when blocks are compared.
SAME = str.maketrans({"«": '"', "»": '"', "“": '"', "”": '"', "„": '"', "’": "'", "‘": "'", "–": "-", "—": "-", "−": "-", " ": " ", " ": " ", " ": " ", "ё": "е", "Ё": "Е"})
LABEL = re.compile(r"\[\s*([A-Za-zА-Яа-яЁё]+(?:[ _-][A-Za-zА-Яа-яЁё]+)*)[ _-]?(\d+)\s*\]")
_TOKENS = re.compile(r"!\[[^\]]*\]\([^)]*\)|\[\^[^\]]+\]")
_EMPHASIS = re.compile(r"[*~`]|(?<!\w)_|_(?!\w)")
_ENUMERATION = re.compile(r"^\s*(?:\d+(?:\.\d+)*[.)]|(?:\d+\.)+\d+|[A-Za-zА-Яа-я]\)|[-*•])\s+")


def labels_of(text: str) -> list[str]:
    """Canonical labels in a text, sorted, repeats kept: two texts hold the same ones if these lists are equal."""
    return sorted(f"[{re.sub('[ -]', '_', m[1]).upper()}_{m[2]}]" for m in LABEL.finditer(text))


def normal(text: str) -> str:
    """What alignment compares: canonical labels, no images, notes, emphasis or numbers of lists, one kind of quotes, dashes and spaces."""
    if "[" in text:
        text = LABEL.sub(lambda m: f"[{re.sub('[ -]', '_', m[1]).upper()}_{m[2]}]", _TOKENS.sub("", text))
    text = _ENUMERATION.sub("", text if text.isascii() else text.translate(SAME))
    if any(c in text for c in "*~`_"):
        text = _EMPHASIS.sub("", text)
    return " ".join(text.split())


def normal_column(text: Column) -> Column:
    """``normal`` for plain lines, in the JVM: signs, enumeration and spaces (no labels or emphasis)."""
    signs = F.translate(text, "".join(map(chr, SAME)), "".join(SAME.values()))
    return F.trim(F.regexp_replace(F.regexp_replace(signs, r"^[ \t]*(([0-9]+\.)+[0-9]*|[0-9]+\)|[A-Za-z]\)|[-*•])[ \t]+", ""), "[ \\t\\n\\r]+", " "))


def escaped(text: str) -> str:
    """Text that Markdown shows as it is; a colon or bracket behind a label does not make it a link."""
    text = re.sub(r"([\\`*_{}<>#|~])", r"\\\1", text)
    text = re.sub(r"^(\s*)([-+>]|\d+[.)])(?=\s)", r"\1\\\2", text)
    return re.sub(r"(\[[^\]\n]+_\d+\])(?=[:(])", "\\1⁠", text.replace("\\_", "_"))


def rendered(runs: Iterable[tuple[str, frozenset]]) -> str:
    """Runs of (text, flags out of b, i, s, u) as Markdown; neighbours with the same flags are one."""
    merged: list[list] = []
    for text, flags in runs:
        if merged and merged[-1][1] == flags:
            merged[-1][0] += text
        elif text:
            merged.append([text, flags])
    out = []
    for text, flags in merged:
        core = text.strip()
        if not core or not flags:
            out.append(escaped(text) if core else text)
            continue
        left, right = text[: len(text) - len(text.lstrip())], text[len(text.rstrip()) :]
        core = escaped(core)
        for flag, a, z in (("u", "<u>", "</u>"), ("s", "~~", "~~"), ("i", "*", "*"), ("b", "**", "**")):
            if flag in flags:
                core = a + core + z
        out.append(left + core + right)
    return "".join(out)


# --- list numbers ------------------------------------------------------------------------------

# The alphabet of lettered lists, which leaves out letters that are not used to number.
RUSSIAN = "абвгдежзиклмнопрстуфхцчшщэюя"
LATIN = "abcdefghijklmnopqrstuvwxyz"
_ROMAN = ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i"))


def letters(n: int, alphabet: str = LATIN) -> str:
    """1 is a, 27 (in Latin) is aa, 28 ab: numbers in letters, without a zero."""
    return "" if n < 1 else letters((n - 1) // len(alphabet), alphabet) + alphabet[(n - 1) % len(alphabet)]


def roman(n: int) -> str:
    out = ""
    for value, sign in _ROMAN:
        out += sign * (n // value)
        n %= value
    return out


FORMATS: dict[str, Callable[[int], str]] = {
    "decimal": str, "decimalZero": str, "lowerLetter": letters, "upperLetter": lambda n: letters(n).upper(),
    "lowerRoman": roman, "upperRoman": lambda n: roman(n).upper(), "russianLower": lambda n: letters(n, RUSSIAN), "russianUpper": lambda n: letters(n, RUSSIAN).upper(),
}


def letters_column(n: Column) -> Column:
    """``letters`` of numbers up to 18278, which have three letters."""
    rounds = [n - 1, F.floor((n - 1) / 26) - 1, F.floor((F.floor((n - 1) / 26) - 1) / 26) - 1]
    return F.concat(*(F.when(r < 0, "").otherwise(F.substring(F.lit(LATIN), (F.pmod(r, F.lit(26)) + 1).cast("int"), F.lit(1))) for r in reversed(rounds)))


def roman_column(n: Column) -> Column:
    """Roman numerals of 1 to 3999 by the digits of n."""
    digits = (("", "m", "mm", "mmm"), ("", "c", "cc", "ccc", "cd", "d", "dc", "dcc", "dccc", "cm"), ("", "x", "xx", "xxx", "xl", "l", "lx", "lxx", "lxxx", "xc"), ("", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix"))
    return F.concat(*(F.get(F.array(*map(F.lit, names)), F.pmod(F.floor(n / 10 ** (3 - k)), F.lit(10)).cast("int")) for k, names in enumerate(digits)))


@dataclass
class ListNumbers:
    """Counters of lists by level; a deeper level starts again under a new item above it."""

    formats: dict[tuple[str, int], tuple[str, str]]  # (list, level): format, template with %1, %2...
    start: dict[tuple[str, int], int] = field(default_factory=dict)
    count: dict[str, dict[int, int]] = field(default_factory=dict)

    def __call__(self, list_id: str, level: int) -> str:
        own = self.count.setdefault(list_id, {})
        own[level] = own.get(level, self.start.get((list_id, level), 1) - 1) + 1
        for deeper in [k for k in own if k > level]:
            del own[deeper]
        kind, template = self.formats[list_id, level]
        if kind == "bullet":
            return "-"
        if kind not in FORMATS:
            raise ValueError(f"list format {kind} is not supported")

        def part(m: re.Match) -> str:
            at = int(m[1]) - 1
            return FORMATS[self.formats[list_id, at][0]](own.get(at, 1))

        return re.sub(r"%(\d)", part, template)


# --- blocks ------------------------------------------------------------------------------------


@dataclass
class Block:
    kind: str  # para, table, frozen, footnote
    text: str
    heading: int = 0
    rows: list[list[str]] = field(default_factory=list)
    note_key: str | None = None

    @property
    def norm(self) -> str:
        return normal(" ".join(c for r in self.rows for c in r)) if self.rows else normal(self.text)

    @property
    def dims(self) -> tuple[int, int]:
        return len(self.rows), max(map(len, self.rows), default=0)


def table_markdown(rows: Sequence[Sequence[str]]) -> str:
    width = max(map(len, rows), default=0)
    lines = ["| " + " | ".join([*(c.replace("|", "\\|").replace("\n", "<br>") for c in r), *[""] * (width - len(r))]) + " |" for r in rows]
    return "\n".join([lines[0], "|" + " --- |" * width, *lines[1:]]) if lines else ""


def frozen_table(rows: Sequence[Sequence[str]]) -> str:
    """A table that can't be edited as Markdown (merged cells, nested tables), as HTML."""
    return "<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows) + "</table>"


def markdown(blocks: Sequence[Block], legend: Iterable[str] = ()) -> str:
    """Blocks with blank lines between, notes last; the legend lists the labels in use, sorted as text."""
    out = ["Labels: " + ", ".join(sorted(set(legend)))] if legend else []
    for b in sorted(blocks, key=lambda b: b.kind == "footnote"):
        if b.kind == "footnote":
            out.append(f"[^{b.note_key}]: {b.text}")
        elif b.rows:
            out.append(frozen_table(b.rows) if b.kind == "frozen" else table_markdown(b.rows))
        else:
            out.append("#" * b.heading + " " * bool(b.heading) + b.text)
    return "\n\n".join(out)


_CHATTER = re.compile(r"^\s*(?:конечно|разумеется|вот|sure|certainly|of course|here(?:'s| is))\b[^\n]{0,200}[:.!]\s*$", re.I)


def precleaned(answer: str, instruction: str = "") -> str:
    """An answer without marks at its start, a fence around all of it, an opening courtesy, or the instruction it repeats."""
    for _ in range(4):
        was = answer
        answer = re.sub("[﻿​⁠]", "", answer).strip("\n")
        if m := re.fullmatch(r"\s*```[a-z]*\n(.*?)\n?```\s*", answer, re.S | re.I):
            answer = m[1]
        head, _, rest = answer.partition("\n")
        if rest and _CHATTER.match(head):
            answer = rest
        if instruction and answer.lstrip().startswith(instruction.strip()):
            answer = answer.lstrip()[len(instruction.strip()) :]
        if answer == was:
            break
    return answer


def _cells(line: str) -> list[str]:
    inner = line.strip().strip("|") if line.strip().startswith("|") else line.strip()
    return [unescaped(c.strip().replace("<br>", "\n")) for c in re.split(r"(?<!\\)\|", inner)]


def unescaped(text: str) -> str:
    return re.sub(r"\\([\\`*_{}<>#|~+\-.!()\[\]])", r"\1", text).replace("⁠", "")


def parsed(answer: str) -> list[Block]:
    """Blocks of a Markdown answer: headings, paragraphs, list items, tables, notes."""
    out: list[Block] = []
    lines, k = answer.split("\n"), 0
    while k < len(lines):
        line = lines[k]
        if not line.strip():
            k += 1
        elif m := re.match(r"\s{0,3}(#{1,6})\s+(.*?)\s*#*\s*$", line):
            out.append(Block("para", unescaped(m[2]), len(m[1])))
            k += 1
        elif m := re.match(r"\[\^([^\]]+)\]:\s*(.*)", line):
            out.append(Block("footnote", unescaped(m[2]), note_key=m[1]))
            k += 1
        elif "|" in line and k + 1 < len(lines) and re.fullmatch(r"\s*\|?\s*:?-+:?\s*(?:\|\s*:?-+:?\s*)*\|?\s*", lines[k + 1]) and "-" in lines[k + 1]:
            rows = [_cells(line)]
            k += 2
            while k < len(lines) and "|" in lines[k] and lines[k].strip():
                rows.append(_cells(lines[k]))
                k += 1
            out.append(Block("table", "", rows=rows))
        elif line.lstrip().startswith("<table"):
            text = line
            while "</table>" not in text and k + 1 < len(lines):
                k += 1
                text += lines[k]
            k += 1
            rows = [re.findall(r"<t[dh][^>]*>(.*?)</t[dh]>", r, re.S) for r in re.findall(r"<tr[^>]*>(.*?)</tr>", text, re.S)]
            out.append(Block("frozen", "", rows=rows))
        else:
            own = [line.strip()]
            k += 1
            item = re.match(r"\s*(?:[-*+]|\d+[.)])\s", line)
            while k < len(lines) and lines[k].strip() and not re.match(r"\s*(?:[-*+]|\d+[.)]|#{1,6}|\[\^)\s?", lines[k]) and "|" not in lines[k] and not item:
                own.append(lines[k].strip())
                k += 1
            out.append(Block("para", unescaped(" ".join(own))))
    return out
