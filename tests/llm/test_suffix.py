import hashlib
import random

import numpy as np
import pytest

from maskloom.llm import suffix as S


def brute(rows, width):
    """rows: distinct (doc_id or None, text)."""
    from xxhash import xxh32_intdigest

    seen, out = set(), {}
    ids = [r[0] for r in rows]
    many = len(set(ids)) < len(ids)
    for doc, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, xxh32_intdigest((r[1] or "").encode(), 5) if many else 0)):
        b = (text or "").encode()
        cover = bytearray(len(b))
        for k in range(len(b) - width + 1):
            if (own := b[k : k + width]) in seen:
                cover[k : k + width] = b"\x01" * width
            seen.add(own)
        spans = sum(1 for k in range(len(b)) if cover[k] and not (k and cover[k - 1]))
        kept = bytes(x for x, c in zip(b, cover, strict=True) if not c)
        out[doc, len(b), sum(cover), spans, hashlib.sha256(kept).hexdigest()] = text
    return set(out)


def test_suffix_arrays():
    rng = random.Random(1)
    for _ in range(300):
        b = bytes(rng.choice(b"ab\x00c") for _ in range(rng.randint(0, 60)))
        assert S.suffix_array(np.frombuffer(b, np.uint8), 64).tolist() == sorted(range(len(b)), key=lambda k: b[k:])
    for b in (b"a" * 500, b"ab" * 300, b"abc" * 100 + b"abd"):
        assert S.suffix_array(np.frombuffer(b, np.uint8), len(b)).tolist() == sorted(range(len(b)), key=lambda k: b[k:])


def test_common_prefixes():
    rng = random.Random(2)
    for b in (b"abcdefghijklm-abcdefghijklX-abcdefghij", b"\x00" * 40, b"ab" * 60, *(bytes(rng.choice(b"ab\x00\xff") for _ in range(rng.randint(0, 90))) for _ in range(100))):
        t = np.frombuffer(b, np.uint8)
        order = S.suffix_array(t, len(b))
        for most in (1, 8, 10, 30, 100):
            want = [next((k for k in range(min(most, len(b) - max(i, j))) if b[i + k] != b[j + k]), min(most, len(b) - max(i, j))) for i, j in zip(order, order[1:], strict=False)]
            assert S.common_prefixes(order, S.words_at(t), most).tolist() == want


def corpus(seed, n=80):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcde fgé") for _ in range(400)) for _ in range(4)]
    rows = [(k, "".join(rng.choice("xyz ") for _ in range(rng.randint(0, 150))) + rng.choice(base)[rng.randint(0, 200) :] + rng.choice(["", "q" * rng.randint(0, 300), "ab" * 90])) for k in range(n)]
    return rows + [(200, None), (201, ""), (202, "ab" * 300), (203, base[1]), (None, base[0]), (None, base[2] + "!")]


@pytest.mark.parametrize("hot", [3, 20_000])
@pytest.mark.parametrize("repeats", [False, True])
def test_equals_brute_force(frame, monkeypatch, hot, repeats):
    monkeypatch.setattr(S, "HOT", hot)
    rows = corpus(hot)[: None if repeats else -2]
    df = frame(rows + ([rows[3], rows[3], rows[-1], (5, rows[9][1] + "other")] if repeats else []))
    got = S.repeats_removed(df).collect()
    assert len(got) == df.count()
    assert {tuple(r) for r in got} == brute({(r.doc_id, r.text) for r in df.collect()}, 100)


def test_long_texts_are_cut_for_hashing_only(frame, monkeypatch):
    monkeypatch.setattr(S, "_PIECE", 512)
    rng = random.Random(9)
    long = "".join(rng.choice("abcdefgh ") for _ in range(5000))
    rows = [(1, long), (2, "zz" + long[700:2300] + "yy" + long[3000:3200]), (3, long[:99]), (4, long[:100])]
    assert {tuple(r) for r in S.repeats_removed(frame(rows)).collect()} == brute(rows, 100)


def test_awkward_rows(awkward, empty):
    rows = S.repeats_removed(awkward).collect()
    assert {tuple(r) for r in rows} == brute({(r.doc_id, r.text) for r in awkward.collect()}, 100) and len(rows) == awkward.count()
    assert S.repeats_removed(empty).count() == 0
