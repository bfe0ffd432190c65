import random
import zlib
from collections import Counter, defaultdict

from maskloom.llm import sharding as K


def spread(sizes, part, n):
    sums = [0] * n
    for s, p in zip(sizes, part, strict=True):
        sums[p] += s
    return max(sums) - min(sums)


def test_differencing_beats_dealing_in_turn():
    rng = random.Random(1)
    for n in (0, 1, 7, 8, 50, 500):
        sizes = sorted((rng.randint(1, 10_000) for _ in range(n)), reverse=True)
        part = K.difference(sizes, 8)
        assert len(part) == n and set(part) <= set(range(8))
        turn = [k % 8 for k in range(n)]
        assert spread(sizes, part, 8) <= spread(sizes, turn, 8)
    assert spread(sizes, part, 8) <= 3


def test_known_example():
    assert spread([8, 7, 6, 5, 4], K.difference([8, 7, 6, 5, 4], 2), 2) == 2  # as differencing does: 8+6 and 7+5+4


def laws(rows, texts, n=8):
    slots, groups, sums = defaultdict(list), defaultdict(set), Counter()
    for r in rows:
        slots[r.shard].append(r.slot)
        sums[r.shard] += r.size
        assert r.law == "bytes" and r.grown_shard is None
    for r, t in texts:
        b = (t or "").encode()
        assert (r.size, r.text_crc32) == (len(b) + 1, zlib.crc32(b))
        groups[b].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(g) == 1 for g in groups.values())
    return [sums[k] for k in range(n)]


def test_shards_of_documents(frame):
    rng = random.Random(2)
    rows = [(k, "x" * rng.randint(0, 400) + str(k)) for k in range(3000)] + [(10_000 + k, "copied text " * 20) for k in range(60)] + [(20_000, None), (20_001, "")]
    df = frame(rows)
    text = dict(rows)
    for most in (100_000, 300):
        got = K.sharded(df, 8, most).collect()
        assert len(got) == len(rows)
        sums = laws(got, [(r, text[r.doc_id]) for r in got])
        largest = max(60 * 241, max(r.size for r in got))  # the copies are one group
        assert max(sums) - min(sums) <= (30 if most > 300 else largest)


def test_a_giant_group_stands_alone(frame):
    rows = [(k, "y" * 1000) for k in range(300)] + [(1000 + k, "z" * (k % 97) + str(k)) for k in range(2000)]
    sums = laws(K.sharded(frame(rows), 8, 300).collect(), [])
    rest = sorted(sums)[:-1]
    assert max(sums) == 300 * 1001 and max(rest) - min(rest) < 0.02 * sum(rest)


def test_awkward_rows(awkward, empty):
    got = K.sharded(awkward).collect()
    assert len(got) == awkward.count()
    laws(got, [])
    assert K.sharded(empty).count() == 0


def test_rounds_of_chunks_are_as_even_as_the_largest_group(spark):
    """Above ``most`` groups the shards differ by less than the largest group, as in one round."""
    rng = random.Random(9)
    sizes = [int(rng.lognormvariate(7, 1.2)) + 1 for _ in range(20_000)]
    groups = spark.createDataFrame([(bytearray(k.to_bytes(4, "big")), n) for k, n in enumerate(sizes)], "item binary, size long").repartition(4)
    shard = {int.from_bytes(r.item, "big"): r.shard for r in K.balanced(groups, 8, 1500, 2000).collect()}
    sums = [0] * 8
    for k, n in enumerate(sizes):
        sums[shard[k]] += n
    assert len(shard) == len(sizes) and max(sums) - min(sums) < max(sizes)


def test_copies_of_one_text_in_many_tasks(frame):
    rows = [(k, "hot text " * 9) for k in range(2000)] + [(5000 + k, f"other {k}") for k in range(500)] + [(None, "hot text " * 9)] * 3
    laws(K.sharded(frame(rows, 6)).collect(), [])
