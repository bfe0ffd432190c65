import gzip
import random
from datetime import date, timedelta

import numpy as np
import pytest

from maskloom.llm import neighbours as A
from maskloom.llm import url_filters as U
from maskloom.llm import warc as R


# --- neighbours --------------------------------------------------------------------------------


def nearest(rows, query, k):
    x = np.array(query[1], float)
    found = [(float(np.sqrt(((np.array(v, float) - x) ** 2).sum())), i) for i, v in rows if i != query[0]]
    return sorted(found)[:k]


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16))
    rows = [(k, (centres[rng.integers(40)] + 0.3 * rng.normal(size=16)).astype(np.float32).tolist()) for k in range(4000)]
    rows += [(5000 + k, rows[7][1]) for k in range(300)]  # one very common vector
    odd = [(9001, None), (9002, []), (9003, [0.0] * 16), (9004, [float("nan")] + [1.0] * 15), (9005, [float("inf")] + [1.0] * 15), (9006, [None] + [1.0] * 15), (9007, [1.0, 2.0]), (None, rows[0][1])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows + odd + rows[:3]], "vec_id long, embedding array<float>, label string").repartition(4)
    return rows, df


@pytest.mark.parametrize("settings", [{}, {"rows_a_part": 300, "block": 128}, {"rows_a_part": 100, "sample": 640}])
def test_recall_and_order(vectors, settings):
    rows, df = vectors
    asked = {i: (i, v) for i, v in rows if i % 100 == 0}
    got = {}
    for r in A.nearest(df, df.where("vec_id % 100 = 0"), 10, **settings).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    assert set(got) == set(asked)
    hits = 0
    for i, found in got.items():
        want = nearest(rows, asked[i], 10)
        assert len(found) == 10 and found == sorted(found) and len({v for _, v in found}) == 10
        place = dict(rows)
        for score, v in found:
            assert score == pytest.approx(float(np.sqrt(((np.array(place[v], float) - np.array(asked[i][1], float)) ** 2).sum())), rel=1e-12, abs=1e-12)
        hits += len({v for _, v in found} & {v for _, v in want})
    assert hits >= 0.9 * 10 * len(got)
    if not settings:
        assert hits >= 0.95 * 10 * len(got)


def test_few_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = [(r.rank, r.vec_id) for r in A.nearest(df, df.where("vec_id = 0"), 10).orderBy("rank").collect()]
    assert got == [(1, 1), (2, 2)]
    assert A.nearest(df.where("false"), df.where("false"), 10).count() == 0


def test_small_tables_have_learned_parts(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, 8))
    index = A.Index(x, A.first_parts(600, 600, 2000, 256), 10, 0.98)
    assert index.parts > 1 and index.router is not None


def test_parts_of_parts():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 8)) + 4 * rng.normal(size=(30, 8))[rng.integers(30, size=3000)]
    root = A.Index(x[:512], 8, 10, 0.98)
    own = root.part(x)
    below = {c: A.Index(x[own == c][:256], 3, 10, 0.98) for c in range(0, 8, 2) if (own == c).sum() > 192}
    tree = A.Tree(root, below, x[:512], 10, 0.98)
    assert tree.parts == 8 + 2 * len(below)
    part = tree.part(x)
    held = np.bincount(part, minlength=tree.parts)
    assert held.sum() == 3000 and len(held) == tree.parts
    for c, first in enumerate(tree.first):
        assert set(part[own == c]) <= set(range(first, first + (3 if c in below else 1)))
    asked = x[::50]
    routes = tree.route(asked, held, 11)
    for k, to in enumerate(routes):
        assert len(set(to.tolist())) == len(to) and held[to].sum() >= 11
        d = ((x - asked[k]) ** 2).sum(1)
        want = np.argsort(d, kind="stable")[1:11]
        routes[k] = np.isin(part[want], to).mean()
    assert np.mean(routes) >= 0.9


def test_parts_are_balanced():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1000, 8))
    part = A.balanced_parts(x, A.nearest_graph(x, 10), 7)
    assert np.bincount(part, minlength=7).max() <= np.ceil(1000 / 7 * 1.1)


# --- URL filters -------------------------------------------------------------------------------


def active(entries, scope, day):
    """Names of lists on which the scope stands on that day."""
    out = []
    for name in {e[0] for e in entries if e[0]}:
        past = [e for e in entries if e[0] == name and e[1] == scope and e[3] and e[3] <= day]
        if past:
            last = max(e[3] for e in past)
            if not any(e[2] == "remove" for e in past if e[3] == last):
                out.append((name, last))
    return out


def test_filters_equal_brute_force(spark):
    rng = random.Random(1)
    start = date(2024, 1, 1)
    scopes = ["a.com", "www.a.com", "b.org", "a.com/x", "www.a.com/x", "com"]
    entries = [(rng.choice(["l1", "l2", None]), rng.choice([*scopes, None]), rng.choice(["add", "remove"]), rng.choice([start + timedelta(rng.randint(0, 40)), None])) for _ in range(60)]
    urls = ["http://www.a.com/x/y", "https://a.com/", "http://u:p@B.ORG:80/x?q", "http://sub.www.a.com./x", "nonsense", None, "", "http://c.net/x"]
    captures = [(k, rng.choice(urls), rng.choice([start + timedelta(rng.randint(0, 50)), None])) for k in range(300)]
    captures += captures[:5]
    c = spark.createDataFrame([(*r, 1) for r in captures], "capture_id long, url string, day date, list int")
    e = spark.createDataFrame(entries, "list string, scope string, action string, day date")
    want = []
    for i, url, day in captures:
        host = {None: "", "": "", "nonsense": "", "http://u:p@B.ORG:80/x?q": "b.org", "http://sub.www.a.com./x": "sub.www.a.com"}.get(url, (url or "//").split("/")[2] if url and "//" in url else "")
        segment = "x" if url and host and "/x" in url else ""
        labels = host.split(".")
        own = [".".join(labels[k:]) for k in range(max(1, len(labels) - 1))] + ([f"{host}/{segment}"] if segment else []) if host else []
        found = sorted((-len(s), name, s, since) for s in own for name, since in (active(entries, s, day) if day else []))
        want.append((i, host, day, *(("drop", found[0][1], found[0][2], found[0][3]) if found else ("keep", None, None, None))))
    got = [tuple(r) for r in U.temporal_list_join(c, e).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert U.temporal_list_join(c, e.where("false")).where("verdict = 'keep'").count() == len(captures)
    assert U.temporal_list_join(c.where("false"), e).count() == 0


# --- WARC --------------------------------------------------------------------------------------

PAGE = '<html><head><title>A &amp; B</title><script>var t="</p>";</script><style>p{}</style></head><body><!-- x --><p>One  two<br>three</p><a href="/l?a=1&amp;b=2">link</a><img src=\'i.png\'></body></html>'


def test_derivatives_link_to_their_response():
    response = R.page_response(7, "http://e.x/", PAGE)
    metadata, conversion = R.derived(response)
    assert metadata["refers_to"] == conversion["refers_to"] == response["record_id"] and metadata["target_uri"] == "http://e.x/" and conversion["date"] == response["date"]
    assert conversion["block"].decode() == "A & B\nOne two\nthree\nlink" and conversion["block_digest"] == R.digest(conversion["block"])
    import json

    about = json.loads(metadata["block"])
    assert about["HTTP-Headers"][0] == ["Content-Type", "text/html; charset=utf-8"] and about["HTML"] == {"title": "A & B", "links": [{"tag": "a", "url": "/l?a=1&b=2"}, {"tag": "img", "url": "i.png"}]}
    assert about["Envelope"]["WARC-Payload-Digest"] == R.digest(PAGE.encode()) == conversion["payload_digest"]


def test_files_round_trip(spark, tmp_path):
    rows = [R.page_response(k, f"http://e.x/{k}", PAGE * k) for k in range(5)]
    every = [x for r in rows for x in (r, *R.derived(r))]
    for name, data in (("a.warc", b"".join(map(R.warc_bytes, every))), ("b.warc.gz", b"".join(gzip.compress(R.warc_bytes(x)) for x in every))):
        assert list(R.records_in(data)) == every
        (tmp_path / name).write_bytes(data)
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress(R.warc_bytes(rows[0])) + b"\x1f\x8b\x08 broken" + gzip.compress(R.warc_bytes(rows[1])))
    files = spark.read.format("binaryFile").load(str(tmp_path))
    records = R.records_of(files)
    assert records.groupBy("path").count().orderBy("path").select("count").collect() == [(15,), (15,), (3,)]
    assert [r.path[-9:] for r in records.where("type = 'unreadable'").collect()] == ["c.warc.gz"]  # and reading goes on behind it
    assert R.derivatives(records, {"path": "string"}).count() == 24


def test_derivatives_equal_plain_reading():
    """Against the standard library alone: http.client's reading of the response, html.parser's words, hashlib's digests."""
    import base64
    import hashlib
    import json
    from html.parser import HTMLParser

    class Words(HTMLParser):
        def __init__(self):
            super().__init__()
            self.silent, self.out = 0, []

        def handle_starttag(self, tag, attrs):
            self.silent += tag in ("script", "style")

        def handle_endtag(self, tag):
            self.silent -= tag in ("script", "style")

        def handle_data(self, data):
            if not self.silent:
                self.out.append(data)

    sha = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
    body = PAGE.encode()
    chunks = b"".join(b"%x\r\n%s\r\n" % (len(c), c) for c in (body[:40], body[40:])) + b"0\r\n\r\n"
    for head, sent in ((b"", body), (b"Transfer-Encoding: chunked\r\n", chunks), (b"Content-Encoding: gzip\r\n", gzip.compress(body)), (b"X: y\r\n", body)):
        block = b"HTTP/1.1 200 OK\r\n" + head + b"\r\n" + sent
        record = R.page_response(1, "http://e.x/", "") | {"block": block, "length": len(block), "block_digest": sha(block), "payload_digest": sha(sent)}
        metadata, conversion = R.derived(record)
        words = Words()
        words.feed(PAGE)
        assert conversion["block"].decode().split() == " ".join(words.out).split() or "".join(conversion["block"].decode().split()) == "".join("".join(words.out).split())
        about = json.loads(metadata["block"])
        assert about["HTTP-Status"] == "HTTP/1.1 200 OK" and [h for h, _ in about["HTTP-Headers"]] == [x.split(b":")[0].decode() for x in head.split(b"\r\n") if x]
        for x in (metadata, conversion):
            assert x["refers_to"] == record["record_id"] and x["payload_digest"] == sha(sent) and x["block_digest"] == sha(x["block"]) and x["length"] == len(x["block"])
    assert R.unpacked([("Content-Encoding", "gzip")], b"not packed") == b"not packed"


def test_awkward_pages(spark):
    rows = [(1, None, None), (2, "", ""), (None, "u", "<p>"), (4, "u", "<script>never closed"), (5, "u", "x" * 200_000), (1, None, None), (6, "é\n", "<!-- open")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, block string")
    got = R.page_derivatives(df).collect()
    assert len(got) == 2 * len(rows) and all(r.block_digest == R.digest(bytes(r.block)) and r.length == len(r.block) for r in got)
    assert {r.page_id for r in got} == {1, 2, None, 4, 5, 6} and R.page_derivatives(df.where("false")).count() == 0
    assert R.derivatives(R.responses(df), {"page_id": "long"}).count() == len(got)
