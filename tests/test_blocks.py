from maskloom.functions import alignment as A
from maskloom.functions import blocks as B

BASE = """# Contract

The first paragraph names [ФИО_1] as the seller here.

The second paragraph does not change at all.

| item | price |
| --- | --- |
| tables | [СУММА_1] |

The third paragraph will be dropped by the answer.

[^1]: A note with [ИНН_ЮЛ_1]."""


def merge(base, answer, **kw):
    return A.merged(B.parsed(base), B.parsed(answer), **kw)


def test_numbers():
    assert [B.letters(n) for n in (1, 26, 27, 28, 52, 53, 702, 703)] == ["a", "z", "aa", "ab", "az", "ba", "zz", "aaa"]
    assert B.letters(1, B.RUSSIAN) == "а" and B.roman(1994) == "mcmxciv"
    numbers = B.ListNumbers({("l", 0): ("decimal", "%1."), ("l", 1): ("lowerLetter", "%1.%2)")})
    assert [numbers("l", k) for k in (0, 1, 1, 0, 1)] == ["1.", "1.a)", "1.b)", "2.", "2.a)"]


def test_normal_form():
    assert B.normal("1.2) **Ёлка** — «тест» [фио-3] ![x](y)") == 'Елка - "тест" [ФИО_3]'
    assert B.labels_of("[ФИО 2] [ФИО_1] [фио_2]") == ["[ФИО_1]", "[ФИО_2]", "[ФИО_2]"]


def test_render_merges_runs_and_escapes():
    b = frozenset("b")
    assert B.rendered([("bold ", b), ("more", b), (" a*b", frozenset())]) == "**bold more** a\\*b"
    assert B.escaped("[ФИО_1]: x").startswith("[ФИО_1]⁠:")


def test_answer_equal_to_base_changes_nothing():
    r = merge(BASE, BASE)
    assert B.markdown(r.blocks) == BASE and set(r.counts) <= {"equal", "notes_missing"} and r.coverage == 1


def test_changes_are_taken_over_if_labels_stay():
    r = merge(BASE, BASE.replace("as the seller here", "as the buyer now"))
    assert "[ФИО_1] as the buyer now" in B.markdown(r.blocks) and r.counts["modified"] == 1


def test_lost_label_keeps_the_original():
    r = merge(BASE, BASE.replace("names [ФИО_1] as", "names somebody as"))
    assert B.markdown(r.blocks) == BASE and len(r.kept_labels) == 1


def test_deletion_waits_for_consent():
    answer = BASE.replace("The third paragraph will be dropped by the answer.\n\n", "")
    r = merge(BASE, answer)
    assert "third paragraph" in B.markdown(r.blocks) and [d[2] for d in r.deletions] == [False]
    assert "third paragraph" not in B.markdown(merge(BASE, answer, confirmed=frozenset([r.deletions[0][0]])).blocks)


def test_insertions_moves_and_tables():
    r = merge(BASE, BASE.replace("The second", "Something quite new and unrelated, inserted.\n\nThe second"))
    assert r.counts["inserted"] == 1 and "quite new" in B.markdown(r.blocks)
    first, second = "The first paragraph names [ФИО_1] as the seller here.", "The third paragraph will be dropped by the answer."
    moved = BASE.replace(second + "\n\n", "").replace(first, second + "\n\n" + first)
    r = merge(BASE, moved)
    assert r.counts["moved"] == 1 and B.markdown(r.blocks) == BASE
    r = merge(BASE, BASE.replace("| tables |", "| chairs |"))
    assert "| chairs | [СУММА_1] |" in B.markdown(r.blocks)
    r = merge(BASE, BASE.replace("| tables | [СУММА_1] |", "| tables | gone |"))
    assert "[СУММА_1]" in B.markdown(r.blocks)


def test_merge_and_split():
    base = "One short sentence about the goods.\n\nAnother one about the price of them."
    joined = base.replace("\n\n", " ")
    r = merge(base, joined)
    assert r.counts["merged"] == 1 and [d[2] for d in r.deletions] == [True]
    r = merge(joined, base)
    assert r.counts["split"] == 1 and len(r.blocks) == 2


def test_notes_join_by_key():
    r = merge(BASE, BASE.replace("A note with", "Another\nnote with").replace("Another\nnote", "A new note"))
    assert "[^1]: A new note with [ИНН_ЮЛ_1]." in B.markdown(r.blocks)


def test_coverage_tells_cut_off_answers():
    base = "\n\n".join(f"Paragraph number {k} about a thing {k * 7919}." for k in range(10))
    assert merge(base, "\n\n".join(base.split("\n\n")[:4])).truncated


def test_preclean():
    assert B.precleaned("﻿```markdown\nSure, here is the text:\n# A\n```") == "# A"


def test_replacements_rebuild_the_new_text():
    for old, new in (("abc def", "abc x def"), ("", "x"), ("abc", "abcd"), ("the old words", "some new words")):
        out, at = "", 0
        for a, z, put in A.replacements(old, new):
            out, at = out + old[at:a] + put, z
        assert out + old[at:] == new or not old


def test_limits_refuse():
    import pytest

    many = [B.Block("para", f"t{k}") for k in range(A.MAX_BLOCKS + 1)]
    with pytest.raises(A.TooLarge):
        A.aligned(many, many[:1])


def test_cheapest_steps_equal_all_ways():
    import numpy as np

    from maskloom.functions import alignment as A

    def every(n, m):
        if (n, m) == (0, 0):
            yield ()
        for a, b in ((1, 1), (1, 0), (0, 1)):
            if n >= a and m >= b:
                yield from ((*way, (a, b)) for way in every(n - a, m - b))

    def price(way, table):
        i = j = 0
        total = 0.0
        for a, b in way:
            total += table[i, j] if a and b else 0.2
            i, j = i + a, j + b
        return total

    rng = np.random.default_rng(1)
    for n in range(5):
        for m in range(5):
            table = rng.choice([1.0, -0.6, -0.75, -0.9], (n, m))
            found = [tuple(map(int, s)) for s in A.cheapest_steps(table)]
            assert abs(price(found, table) - min(price(w, table) for w in every(n, m))) < 1e-9
