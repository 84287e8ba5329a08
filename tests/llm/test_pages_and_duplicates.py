import itertools
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from leadloom.llm import simhash, warc, wrapper
from leadloom.llm.common import table
from leadloom.llm.queries import QUERIES

PAGES = "page_id bigint, url string, html string, text string, wrapper string, host string, n_chars string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "t", "w", "h", "n") for r in rows], PAGES)


# wrapper induction


def _most_pairs(a, b):
    """Simple tree matching by its recursion, without a table."""
    if a[0] != b[0]:
        return 0
    if a[0] == "":
        return 1

    def best(x, y):
        if not x or not y:
            return 0
        return max(best(x[1:], y), best(x, y[1:]), best(x[1:], y[1:]) + _most_pairs(x[0], y[0]) if x[0][0] == y[0][0] else 0)

    return 1 + best(a[1], b[1])


def test_tree_matching_equals_its_recursion():
    rng = random.Random(0)

    def tree(depth):
        if depth == 0 or rng.random() < 0.2:
            return ["", 1, 1, 1, []]
        return [rng.choice("ab"), [tree(depth - 1) for _ in range(rng.randint(0, 3))]]

    for _ in range(300):
        a, b = tree(3), tree(3)
        assert wrapper.tree_matching(a, b) == _most_pairs(a, b)


def page(body, host="h.example", n=1):
    return f"https://{host}/{n}", f"<!DOCTYPE html><html><head><title>T</title><style>x</style></head><body>{body}</body></html>"


def test_template_is_left_out_and_slots_stay(spark):
    rows = []
    for n in range(12):
        body = (
            f"<div><span>Welcome to our site</span></div><div id=c><h2>Title {n}</h2><p>Body&nbsp;{n} &amp; <b>bold</b><br>more<p>"
            f"Second  \n {n}</p></div><div><span>Printed on paper</span></div>"
        )
        rows.append((n, *page(body, n=n)))
    got = {r["page_id"]: r["text"] for r in wrapper.extract(pages(spark, rows)).collect()}
    for n in range(12):
        assert got[n] == f"Title {n}\n\nBody {n} & bold more\n\nSecond {n}"


def test_boilerplate_is_known_by_its_marks():
    body = (
        "<header><a href=/>Logo</a></header><nav><ul><li>Home<li>About</ul></nav><div class='cookie-notice'>We use</div>"
        "<main><article><h1>Title</h1><p>One &lt;tag&gt;</p><div class=share-buttons>Share</div><ul><li>first<li>second</ul>"
        "<form><input><button>Go</button></form><script>var a='</p>';</script><!-- no --><p>Two</p></article>"
        "<section id=comments><p>nice post</p></section></main><aside>Side</aside><div class='ad'>Buy</div><footer>&copy;</footer>"
    )
    assert wrapper.main_text(page(body)[1]) == "Title\n\nOne <tag>\n\nfirst\n\nsecond\n\nTwo"
    assert wrapper.main_text("<p>no end <i>here") == "no end here"
    assert wrapper.main_text("<div>" * 3000 + "deep" + "</div>") == "deep"
    assert wrapper.main_text("a < b and <3 <p title='>'>c") == "a < b and <3\n\nc"


def test_copies_alone_are_no_template(spark):
    rows = [(n, *page("<div><p>Same text everywhere</p></div>", n=n)) for n in range(9)]
    assert {r["text"] for r in wrapper.extract(pages(spark, rows)).collect()} == {"Same text everywhere"}


def test_page_edges(spark):
    rows = [(1, None, None), (2, None, ""), (3, "no url", "<p>x</p>"), (3, "no url", "<p>x</p>"), (None, "http://u/", "<article></article>")]
    got = sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in wrapper.extract(pages(spark, rows)).collect())
    assert got == [("1", "", 0), ("2", "", 0), ("3", "x", 1), ("3", "x", 1), ("None", "", 0)]
    assert wrapper.extract(pages(spark, [])).count() == 0
    long = "<article>" + "<p>word word</p>" * 20_000 + "</article>"
    assert wrapper.extract(pages(spark, [(1, "http://u/", long)])).first()["n_chars"] == 20_000 * 11 - 2


def test_long_lists_of_siblings_stay_cheap():
    rng = random.Random(8)
    regular = "".join(f"<h2>h {i}</h2><p>p {i}</p>" for i in range(20_000))
    assert wrapper.size(wrapper.shape_of(wrapper.read(f"<article>{regular}</article>")[0])) == 6
    odd = ["".join(f"<{t}>x</{t}>" for t in rng.choices(["p", "pre", "ul", "h2", "h3", "dl"], k=4_000)) for _ in range(2)]
    a, b = (wrapper.shape_of(wrapper.read(o)[0]) for o in odd)
    both = wrapper.merge(a, b)
    assert max(wrapper.size(a), wrapper.size(b)) <= wrapper.size(both) <= wrapper.size(a) + wrapper.size(b)


def test_many_shapes_fold_in_steps(spark, monkeypatch):
    rng = random.Random(4)
    rows = []
    for n in range(300):
        parts = [f"<{t}>{t} {n}</{t}>" for t in rng.choices(["p", "h2", "blockquote", "pre"], k=rng.randint(1, 6))]
        rows.append((n, *page(f"<div><span>Slogan</span></div><div id=c>{''.join(parts)}</div>", n=n)))
    got = wrapper.extract(pages(spark, rows)).collect()
    assert wrapper.induce(pages(spark, rows).withColumn("host", F.lit("h"))).count() == 1
    assert all("Slogan" not in r["text"] and r["text"].endswith(str(r["page_id"])) for r in got)


# warc


def test_derivatives_round_trip(spark, tmp_path):
    rows = [
        (1, "http://u/\r\nX: y", "<title>A &amp; b</title><a href='/x?a=1&amp;b'>l</a><p>One<p>Two\r\n\r\nWARC/1.1"),
        (2, None, None), (3, "http://e/", ""), (4, "http://é/", "<p>É 🙂</p>"), (4, "http://é/", "<p>É 🙂</p>"),
        (5, "http://long/", "<p>x</p>" * 20_000),
    ]
    responses = warc.responses_of(pages(spark, rows))
    derived = warc.derive(responses.withColumn("block", F.lit("clash")))
    records = derived.collect()
    assert len(records) == 2 * len(rows)
    names = {r["record_id"] for r in responses.collect()}
    assert {r["refers_to"] for r in records} == names
    digests = {r["record_id"]: r["warc_headers"]["WARC-Payload-Digest"] for r in responses.collect()}
    for r in records:
        data = r["block"].encode()
        assert r["source_digest"] == digests[r["refers_to"]]
        assert r["block_digest"] == warc.digest(data) and r["content_length"] == len(data)
    for compression in ("none", "gzip"):
        path = str(tmp_path / compression)
        warc.write_records(derived, path, compression)
        back = warc.read_records(spark, path).collect()
        assert sorted((r["headers"]["WARC-Record-ID"], bytes(r["block"]).decode()) for r in back) == sorted(
            (r["record_id"], r["block"]) for r in records
        )
        assert all(r["headers"]["WARC-Refers-To"] in names for r in back)
    meta = next(r for r in records if r["page_id"] == 1 and r["warc_type"] == "metadata")
    assert '"title": "A & b"' in meta["block"] and '"url": "/x?a=1&b"' in meta["block"]
    text = next(r for r in records if r["page_id"] == 1 and r["warc_type"] == "conversion")
    assert text["block"] == "l\nOne\nTwo WARC/1.1"
    assert warc.derive(warc.responses_of(pages(spark, []))).count() == 0


def test_responses_are_read_from_files(spark, tmp_path):
    payload = b"<p>caf\xe9</p>"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=iso-8859-1\r\n\r\n" + payload
    head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Target-URI: http://a/\r\nContent-Length: {len(http)}\r\n\r\n"
    other = b"WARC/1.0\r\nWARC-Type: request\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(other + head.encode() + http + b"\r\n\r\n" + other)
    responses = warc.read_responses(spark, str(tmp_path))
    assert [(r["record_id"], r["status"], bytes(r["payload"])) for r in responses.collect()] == [("<urn:uuid:1>", 200, payload)]
    found = {r["warc_type"]: r for r in warc.derive(responses).collect()}
    assert found["conversion"]["block"] == "café" and found["metadata"]["source_digest"] == warc.digest(payload)


def test_every_page_gives_two_records(spark):
    got = QUERIES["op5_warc_derivatives"](spark, "/root/testdata/sf0.001")
    assert got.count() == 2 * table(spark, "/root/testdata/sf0.001", "pages").count()


# near duplicates


def _plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _plain_components(rows):
    marks = [_plain_fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if (marks[i] ^ marks[j]).bit_count() <= 4:
            group[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), doc), doc)
    return sorted((doc, f"{marks[i]:016x}", least[root(i)]) for i, (doc, _) in enumerate(rows))


def test_components_equal_all_pairs(spark):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, "/root/testdata/sf0.001", "documents").collect()]
    got = QUERIES["op3_pigeonring"](spark, "/root/testdata/sf0.001").collect()
    assert sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == _plain_components(rows)


def test_component_edges(make):
    rows = [(9, None), (8, ""), (7, " \n"), (6, "A b"), (5, "a  B"), (5, "a  B"), (4, "É x y z"), (3, "é x y z"), (2, "w " * 30_000)]
    got = simhash.components(make(rows))
    mine = sorted((r["doc_id"], f"{r['fp'] % (1 << 64):016x}", r["component_id"]) for r in got.collect())
    assert mine == _plain_components(rows)
    kept = simhash.one_of_each(make(rows))
    assert kept.columns == make(rows).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for *_, c in mine})
    assert simhash.components(make([])).count() == 0
    assert simhash.components(make([(None, "a b"), (None, "c d")])).where("component_id is null").count() == 2


@pytest.mark.parametrize("block", [3, 50, 4096])
def test_blocks_lose_no_link(spark, block):
    rng = random.Random(block)
    centre = rng.getrandbits(64)
    marks = {rng.getrandbits(64) for _ in range(200)}
    for _ in range(400):
        x = centre
        for _ in range(rng.randint(0, 6)):
            x ^= 1 << rng.randrange(64)
        marks.add(x)
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in marks]
    df = spark.createDataFrame(signed, "fp bigint")
    got = {r["node"] % (1 << 64): r["centre"] % (1 << 64) for r in simhash.centres(simhash.links(df, block)).collect()}
    group = {x: x for x in marks}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, b in itertools.combinations(marks, 2):
        if (a ^ b).bit_count() <= 4:
            group[root(a)] = root(b)
    ours, plain = {}, {}
    for x in marks:
        ours.setdefault(got.get(x, x), set()).add(x)
        plain.setdefault(root(x), set()).add(x)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, plain.values()))


def test_pigeonring_keys_reach_every_pair_within_budget():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
    other = base.copy()
    for i in range(len(other)):
        for bit in rng.choice(64, rng.integers(0, 6), replace=False):
            other[i] ^= np.uint64(1) << np.uint64(bit)
    close = np.bitwise_count(base ^ other) <= 4
    starts = np.stack([simhash._in_budget(base ^ other, np.full(len(base), s)) for s in range(5)])
    assert (starts.any(axis=0) == close).all()


def test_bodies_lose_their_encodings():
    import gzip
    import json
    import zlib

    page = b"<p>First half</p><p>Second half</p>"
    members = gzip.compress(page[:17]) + gzip.compress(page[17:])
    chunks = b"".join(b"%x;x=1\r\n%s\r\n" % (len(c), c) for c in (members[:9], members[9:])) + b"0\r\n\r\n"
    raw = zlib.compressobj(wbits=-15)
    for payload, headers in (
        (page, {}), (members, {"Content-Encoding": "gzip"}), (chunks, {"content-encoding": "GZIP", "Transfer-Encoding": "chunked"}),
        (zlib.compress(page), {"Content-Encoding": "deflate"}), (raw.compress(page) + raw.flush(), {"Content-Encoding": "deflate"}),
        (page, {"Content-Encoding": "gzip", "Transfer-Encoding": "chunked"}), (gzip.compress(zlib.compress(page)), {"Content-Encoding": "deflate, gzip"}),
    ):
        assert warc.body_of(payload, headers) == (page, []), headers
    for payload, left in ((b"\x0b\x02\x80", ["br"]), (b"\x1f\x8bbroken", ["gzip"])):
        rows = warc.derivatives("<urn:x>", "http://a.example/", None, {}, 200, {"Content-Encoding": left[0]}, payload)
        assert json.loads(rows[0][-1])["undecoded"] == left and rows[1][-1] == ""
