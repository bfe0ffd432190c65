"""Opening of labels within values, for the label table of one document."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

#: label: texts around the labels of its value (one more than those), these labels as written, and as the table has them
Table = Mapping[str, tuple[Sequence[str], Sequence[str], Sequence[str]]]


def finished(table: Table) -> tuple[list[str], set[str]]:
    """Labels of which each stands behind those in its value, and those that lead back to themselves: strong components by Tarjan, without recursion."""
    number: dict[str, int] = {}
    low: dict[str, int] = {}
    order, circular, open_ = [], set(), {}
    for root in table:
        work = [] if root in number else [(root, iter(table[root][2]))]
        while work:
            at, rest = work[-1]
            if at not in number:
                number[at] = low[at] = len(number)
                open_[at] = None
            for to in rest:
                if to in table and to not in number:
                    work.append((to, iter(table[to][2])))
                    break
                if to in open_:
                    low[at] = min(low[at], number[to])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[at])
                if low[at] == number[at]:
                    group = []
                    while not group or group[-1] != at:
                        group.append(open_.popitem()[0])
                    order += group
                    if len(group) > 1 or at in table[at][2]:
                        circular.update(group)
    return order, circular


def opened(table: Table, wanted: Sequence[str], longest: int) -> list[tuple[str, str | None, int]]:
    """(label, value, circular labels that stay in it) of the labels ``wanted``; circular ones have no value.

    Lengths are summed first, so that nothing longer than ``longest`` is put together; texts are made for the labels wanted alone.
    """
    order, circular = finished(table)
    length: dict[str, int] = {}
    closed: dict[str, int] = {}
    for label in order:
        if label not in circular:
            around, written, refs = table[label]
            length[label] = sum(map(len, around)) + sum(length[r] if r in length else len(w) for w, r in zip(written, refs, strict=True))
            closed[label] = sum(1 if r in circular else closed.get(r, 0) for r in refs)
    out: list[tuple[str, str | None, int]] = []
    for label in wanted:
        if label in circular:
            out.append((label, None, 1))
            continue
        if length[label] > longest:
            raise ValueError(f"a label opens to {length[label]} characters, more than the longest text of {longest}")
        made: list[str] = []
        todo: list[tuple[str, str | None]] = [("", label)]
        while todo:
            text, ref = todo.pop()
            if ref not in length:
                made.append(text)
            elif length[ref]:
                around, written, refs = table[ref]
                todo.append((around[-1], None))
                for k in range(len(refs) - 1, -1, -1):
                    todo += [(written[k], refs[k]), (around[k], None)]
        out.append((label, "".join(made), closed[label]))
    return out
