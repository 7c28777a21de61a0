"""Archives, URL rules and images."""

from __future__ import annotations

import base64
import gzip
import hashlib
import json

import duckdb
import numpy as np
import pytest

from orderlake.llm import images, urls, warc

PAGES = "page_id long, url string, html string"
ROWS = [
    (5, "http://a.org/x", "<p>same</p>"),
    (2, "http://b.org/y", "<p>same</p>"),
    (2, "http://b.org/y", "<p>same</p>"),
    (9, "http://c.org/\r\nInjected: 1", "ünïcödé\r\n\r\nWARC/1.1\r\n"),
    (7, None, None),
    (8, "x", ""),
    (None, "http://d.org", "solo"),
    (11, "long", "z" * 300000),
]


def test_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, PAGES).selectExpr("*", "1 AS payload", "2 AS shard")
    folder = f"file://{tmp_path}/a"
    warc.write_warc(pages, folder, shard_bytes=2000, roll_bytes=500)
    got = warc.read_warc(spark, folder).collect()
    assert len(got) == len(ROWS)
    first, want = {}, []
    for i, u, h in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        body = (h or "").encode()
        seen = first.setdefault(body, i) if body in first else None
        kind = "revisit" if body in first and seen is not None else "response"
        first.setdefault(body, i)
        want.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), kind, first[body] if kind == "revisit" else None))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == sorted(want, key=repr)
    texts = {(r.page_id, r.payload) for r in got if r.record_type == "response"}
    assert (9, ROWS[3][2]) in texts and (11, ROWS[7][2]) in texts


def test_files_are_deterministic_and_committed(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"page {i % 7} " * (i % 11 * 30)) for i in range(200)], PAGES)
    digests = []
    for k in range(2):
        folder = tmp_path / f"w{k}"
        warc.write_warc(pages.repartition(k + 1), f"file://{folder}", shard_bytes=20000, roll_bytes=3000)
        listed = [json.loads(x)["file"] for f in (folder / "manifest").glob("part-*.json") for x in f.read_text().splitlines()]
        assert sorted(p.name for p in folder.iterdir() if not p.name.startswith(".")) == sorted([*listed, "manifest"])
        assert len(listed) > 3
        digests.append({n: hashlib.sha256((folder / n).read_bytes()).hexdigest() for n in listed})
        for n in listed:
            for head, _ in warc.parse(gzip.decompress((folder / n).read_bytes())):
                assert head["WARC-Type"] in ("warcinfo", "response", "revisit")
    assert digests[0] == digests[1]
    # a file that no manifest names is not read
    (tmp_path / "w0" / "stray.warc.gz").write_bytes(b"junk")
    assert warc.read_warc(spark, f"file://{tmp_path}/w0").count() == 200


def test_no_shard_takes_what_an_outlier_or_one_id_leaves(spark):
    rows = [(i, f"http://h/{i}", "x" * 100 + str(i)) for i in range(1000)] + [(10**15, "far", "far")]
    rows += [(None, f"n{i}", f"null {i}" * 9) for i in range(1000)] + [(7, f"r{i}", f"often {i}" * 9) for i in range(1000)]
    placed, n = warc.plan(spark.createDataFrame(rows, PAGES), 20_000, 0)
    size = sorted(r["count"] for r in placed.groupBy("shard").count().collect())
    assert n > 60 and len(size) >= n - 2 and size[-1] <= 3 * size[len(size) // 2]
    again, _ = warc.plan(spark.createDataFrame(rows[::-1], PAGES).repartition(7), 20_000, 0)
    place = lambda f: sorted((str(r.page_id), r.url, r.shard) for r in f.collect())
    assert place(again) == place(placed)


def test_schemes_of_hadoop():
    assert warc.uri("file:/tmp/a") == warc.uri("file:///tmp/a") == "file:///tmp/a"
    assert warc.uri("s3a://bucket/a/b") == "s3://bucket/a/b" and warc.uri("hdfs://h:1/a") == "hdfs://h:1/a"


def test_damage_is_seen(spark, tmp_path):
    folder = f"file://{tmp_path}/d"
    warc.write_warc(spark.createDataFrame([(1, "u", "payload text")], PAGES), folder)
    name = next((tmp_path / "d").glob("*.warc.gz"))
    raw = gzip.decompress(name.read_bytes()).replace(b"payload text", b"payload tExt")
    name.write_bytes(gzip.compress(raw))
    with pytest.raises(Exception, match="digest"):
        warc.read_warc(spark, folder).collect()


def test_no_pages(spark, tmp_path):
    none = spark.createDataFrame([], PAGES)
    warc.write_warc(none, f"file://{tmp_path}/n")
    assert warc.read_warc(spark, f"file://{tmp_path}/n").count() == 0
    assert urls.judge(none, spark.createDataFrame(urls.RULES, "host string, path string, verdict string")).count() == 0


RULES = [("Example.com", "/", "block"), ("example.com", "/ok", "allow"), ("a.example.com", "/ok", "block"), ("com", "", "allow"), ("x.y", "/p", "block"), ("x.y", "/p", "allow"), ("", "/", "block"), (None, "/", "block")]
URLS = ["http://example.com/", "http://A.EXAMPLE.com/okay?q", "https://badexample.com/ok", "ftp://b.a.example.com/ok/1#f", "http://example.com", "http://example.com?x=/ok", "nothing", "", None, "http://x.y/p", "http://x.y/q", "a://b://c/d", "://com/", "http://" + "s." * 60 + "example.com/" + "p" * 5000]


def test_url_rules(spark):
    frame = spark.createDataFrame([(i, u, "extra") for i, u in enumerate(URLS)] + [(0, URLS[0], "again")], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(frame, spark.createDataFrame(RULES, "host string, path string, verdict string")).collect()}
    rules = {}
    for h, p, v in RULES:
        if h:
            rules[h.lower(), p] = max(v, rules.get((h.lower(), p), ""))
    for i, u in enumerate(URLS):
        rest = (u or "").partition("://")[2] if u and "://" in u else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = rest[:cut].lower(), rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
        fits = [(len(h) + len(p), len(h), v, h + p) for (h, p), v in rules.items() if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        assert got[i] == (host, path, best and best[3], best[2] if best else "allow"), u


def test_url_oracle_on_odd_urls(spark):
    rows = [(i, u) for i, u in enumerate([u for u in URLS if u is not None])]
    c = duckdb.connect()
    c.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    c.executemany("INSERT INTO pages VALUES (?, ?)", rows)
    want = sorted(c.execute(f"SELECT page_id, host, path, rule, verdict FROM ({urls.ORACLE})").fetchall(), key=repr)
    rules = spark.createDataFrame(urls.RULES, "host string, path string, verdict string")
    assert sorted(map(tuple, urls.judge(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()), key=repr) == want


IMAGE = "image_id long, width int, height int, pixels binary"


def drawn(i, m):
    return (i, m.shape[1], m.shape[0], images.pixels(m).tobytes())


def test_copies_are_found(spark):
    rng = np.random.RandomState(4)
    originals = [images.mosaic(rng.normal(0, 0.15, 64).astype(np.float32)) for _ in range(60)]
    rows = [drawn(i, m) for i, m in enumerate(originals)]
    rows += [drawn(1000 + i, images.edited(m)) for i, m in enumerate(originals) if i % 2]
    rows += [drawn(2000 + i, originals[0]) for i in range(20)]  # equal pixels
    rows += [(3000, 0, 0, b""), (3001, None, None, None), (3002, 40, 40, bytes(1600)), (3003, 3, 3, b"123456789"), (3004, 40, 40, b"short")]
    got = {r.image_id: r for r in images.image_classes(spark.createDataFrame(rows, IMAGE)).collect()}
    assert len(got) == len(rows)
    for i in range(60):
        assert got[i].class_id == i
        if i % 2:
            assert got[1000 + i].class_id == i and got[1000 + i].inliers >= 5
    assert all(got[2000 + i].class_id == 0 and got[2000 + i].n_copies == 21 for i in range(20))
    assert all(got[i].inliers == 0 for i in (3000, 3001, 3002, 3003, 3004))


def pasted(n):
    """Images, and others that hold a noisy part of each; few share table values."""
    rng = np.random.RandomState(21)
    rows = []
    for i in range(n):
        m, other = (images.mosaic(rng.normal(0, 0.15, 64).astype(np.float32)) for _ in range(2))
        other[20:54, 24:58] = m[12:46, 8:42]
        rows += [drawn(i, m), drawn(100 + i, other + rng.normal(0, 12, other.shape))]
    return rows


def test_no_link_is_lost(spark, monkeypatch):
    rows = pasted(40)
    found = {i: images.describe(np.frombuffer(p, np.uint8).reshape(1, h, w))[1:] for i, w, h, p in rows}
    first = {i: i for i in found}
    links = 0
    for a in found:
        for b in found:
            if a < b and images.consensus(*found[a], *found[b]) >= 5:
                links += 1
                low, high = sorted((first[a], first[b]))
                first = {i: low if k == high else k for i, k in first.items()}
    assert links >= 10
    for chunk in (images.CHUNK, 600):  # one and several chunks
        monkeypatch.setattr(images, "CHUNK", chunk)
        got = images.image_classes(spark.createDataFrame(rows, IMAGE)).collect()
        assert {r.image_id: r.class_id for r in got} == first
    # table values alone do not find them all
    got = images.image_classes(spark.createDataFrame(rows, IMAGE), whole=False).collect()
    assert len({r.class_id for r in got}) > len(set(first.values()))


def test_bound_loses_no_match():
    rng = np.random.RandomState(3)
    bits = rng.randint(0, 256, (700, images.BITS // 8)).astype(np.uint8)
    flip = np.packbits(rng.rand(700, images.BITS) < 0.09, axis=1)
    a, b = bits, np.vstack([bits ^ flip, bits, bits[:3]])
    axes = images.axes_of(a)
    i, j = images.matches(images.bound_vectors(a, axes, True), a, images.bound_vectors(b, axes, False), b)
    want = np.nonzero(np.bitwise_count(a[:, None, :] ^ b[None, :, :]).sum(2) <= images.FLIPS)
    assert sorted(zip(i.tolist(), j.tolist())) == sorted(zip(*(x.tolist() for x in want)))


def test_cells_lose_no_match(monkeypatch):
    rng = np.random.RandomState(6)
    wide = images.BITS // 8
    centres = rng.randint(0, 256, (40, wide)).astype(np.uint8)
    bits = centres[rng.randint(0, 40, 3000)] ^ np.packbits(rng.rand(3000, images.BITS) < rng.choice([0.02, 0.05, 0.2], 3000)[:, None], axis=1)
    bits[:5], bits[5:9] = 0, 255  # complements: more flips than a byte holds
    monkeypatch.setattr(images, "CELLS", 30)
    middles = np.vstack([images.middles_of(bits[:2000]), -np.ones((1, images.BITS), np.float32)])
    flips = images.flips_from(middles, bits)
    none = np.zeros((len(bits), 4), np.float32)
    cut = np.linspace(0, len(bits), 101).astype(int)
    each = [[x[a:b].tobytes() for a, b in zip(cut, cut[1:])] for x in (none, bits, flips.argmin(0).astype(np.uint16), flips.min(0))]
    there = images.Corners.of(np.arange(100), np.arange(100), *each)
    products, plain = [], images.matches
    monkeypatch.setattr(images, "matches", lambda a, x, b, y: (products.append(len(a) * b.shape[1]), plain(a, x, b, y))[1])
    got = [(i, j) for x, y in images.near_corners(bits, images.Chunk(there, middles)) for i, j in zip(x.tolist(), y.tolist())]
    want = np.nonzero(np.bitwise_count(bits[:, None, :] ^ there.bits[None, :, :]).sum(2, dtype=np.uint16) <= images.FLIPS)
    assert sorted(got) == sorted(zip(*(x.tolist() for x in want))) and len(got) > len(bits)
    # most pairs of corners need no product
    assert sum(products) < len(bits) ** 2 / 3


def test_units_of_many_matches_are_cut(spark, monkeypatch):
    rows = pasted(30)
    whole = {r.image_id: r.class_id for r in images.image_classes(spark.createDataFrame(rows, IMAGE)).collect()}
    found = [images.describe(np.frombuffer(p, np.uint8).reshape(1, h, w))[1:] for _, w, h, p in rows]
    middles = images.middles_of(np.vstack([b for _, b in found]))
    flips = [images.flips_from(middles, b) for _, b in found]
    rep = np.arange(len(rows))
    there = images.Corners.of(rep, rep, [g.tobytes() for g, _ in found], [b.tobytes() for _, b in found], [f.argmin(0).astype(np.uint16).tobytes() for f in flips], [f.min(0).tobytes() for f in flips])
    chunk = images.Chunk(there, middles)
    want = sorted(images.agreeing(there, 0, len(rep), chunk, 5))
    monkeypatch.setattr(images, "HELD", 20)
    assert sorted(images.agreeing(there, 0, len(rep), chunk, 5)) == want and len(want) >= len(rep) - len(set(whole.values()))


def test_turned_images_agree():
    rng = np.random.RandomState(8)
    m = images.pixels(images.mosaic(rng.normal(0, 0.2, 64).astype(np.float32)))
    a, b = images.describe(m[None]), images.describe(np.rot90(m)[None].copy())
    assert images.consensus(a[1], a[2], b[1], b[2]) >= 5


def test_no_images(spark):
    assert images.image_classes(spark.createDataFrame([], IMAGE)).count() == 0


def test_links_of_a_large_group_are_few(spark, monkeypatch):
    monkeypatch.setattr(images, "SMALL", 2)
    monkeypatch.setattr(images, "BLOCK", 6)
    rng = np.random.RandomState(15)
    m = images.mosaic(rng.normal(0, 0.15, 64).astype(np.float32))
    rows = [drawn(i, m + rng.normal(0, 0.4, m.shape)) for i in range(60)]
    rows += [drawn(100 + i, images.mosaic(rng.normal(0, 0.15, 64).astype(np.float32))) for i in range(5)]
    written, plain = {}, images.durable

    def durable(table, name):
        out = plain(table, name)
        if name.startswith("image-links"):
            written[name] = out.count()
        return out

    monkeypatch.setattr(images, "durable", durable)
    got = {r.image_id: r.class_id for r in images.image_classes(spark.createDataFrame(rows, IMAGE), whole=False).collect()}
    assert got == {i: 0 if i < 100 else i for i, *_ in rows}
    # units of two blocks find nothing that those of one have left apart
    assert 60 < sum(written.values()) < 1_100


def test_corners_of_two_scales_meet_from_the_coarser_side(spark, monkeypatch):
    rng = np.random.RandomState(33)
    plain = [images.pixels(images.mosaic(rng.normal(0, 0.15, 64).astype(np.float32))) for _ in range(24)]
    rows = [drawn(i, m) for i, m in enumerate(plain)]
    rows += [drawn((100 if i % 4 else -100) + i, np.kron(m, np.ones((2, 2)))) for i, m in enumerate(plain) if i % 2 == 0]
    found = [images.describe(np.frombuffer(p, np.uint8).reshape(1, h, w))[1:] for _, w, h, p in rows]
    want = {(a, b) for a in range(len(rows)) for b in range(a) if images.consensus(*found[a], *found[b]) >= 5}
    assert len(want) >= 12
    middles = images.middles_of(np.vstack([b for _, b in found]))
    flips = [images.flips_from(middles, b) for _, b in found]
    rep = np.arange(len(rows))
    there = images.Corners.of(rep, rep, [g.tobytes() for g, _ in found], [b.tobytes() for _, b in found], [f.argmin(0).astype(np.uint16).tobytes() for f in flips], [f.min(0).tobytes() for f in flips])
    counted, plain_matches = [], images.matches
    fine = {bytes(b) for g, w in found for b, s in zip(w, g[:, 2]) if s == 1}
    coarse = {bytes(b) for g, w in found for b, s in zip(w, g[:, 2]) if s > 1} - fine
    fine -= {bytes(b) for g, w in found for b, s in zip(w, g[:, 2]) if s > 1}

    def matches(a, x, b, y):
        counted.append(sum(bytes(k) in fine for k in x) * sum(bytes(k) in coarse for k in y))
        return plain_matches(a, x, b, y)

    monkeypatch.setattr(images, "matches", matches)
    got = {(max(p), min(p)) for p in images.agreeing(there, 0, len(rep), images.Chunk(there, middles), 5)}
    assert want <= got
    # a finer descriptor is not compared with a coarser corner, whose cells are wide
    assert sum(counted) == 0
    monkeypatch.setattr(images, "CHUNK", 1000)
    label = {i: i for i, *_ in rows}
    for a, b in want:
        low, high = sorted((label[rows[a][0]], label[rows[b][0]]))
        label = {i: low if k == high else k for i, k in label.items()}
    classes = {r.image_id: r.class_id for r in images.image_classes(spark.createDataFrame(rows, IMAGE)).collect()}
    assert classes == label


def test_all_flips_count_complements():
    rng = np.random.RandomState(9)
    bits = rng.randint(0, 256, (21, images.BITS // 8)).astype(np.uint8)
    a, b = (np.ascontiguousarray(x).view(np.uint64) for x in (bits, np.vstack([bits, ~bits])))
    want = np.bitwise_count(a[:, None] ^ b).sum(2)
    near = images.all_flips(a, b)
    assert ((near <= images.FLIPS) == (want <= images.FLIPS)).all() and near.max() == 255
    assert (images.flips_between(a, b[len(bits) :]) == images.BITS).all()
