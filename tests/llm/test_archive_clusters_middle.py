"""Archives, centroid clustering and fill-in-middle against plain versions, round trips and odd rows."""

import base64
import hashlib
import re
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest

from tidewave.llm import centroids, fill_in_middle, queries, web_archive

SF = "/root/testdata/sf0.001"


def plain_middle(doc_id, text, rate=50, spm=80, seed=42):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    form = "spm" if h[3] % 100 < spm else "psm"
    return len(units), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_matches_lists_of_units(spark):
    odd = [None, "", " ", "\n\t ", "a", " a", "a ", "a<P>b c", "x<S", "<", "é ü  語 🙂 x\x1cy", "word " * 9000, "x" * 300_000, " " * 70_000, "a<<S b <P c> <M d"]
    rows = [(i, t, "n", 1, "o") for i, t in enumerate(odd * 20)] + [(None, "one two three", None, None, None)] * 2 + [(-5, "p q r s t", "", 0, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, form string, n int, output string")
    for options in ({}, {"rate": 100, "spm": 50, "seed": 7}):
        out = fill_in_middle.fill_in_middle(frame, **options)
        got = out.withColumn("whole", fill_in_middle.restored(out["form"], out["output"])).collect()
        want = [(r[0], *plain_middle(r[0], r[1], **options)) for r in rows]
        assert sorted((tuple(r[:6]) for r in got), key=repr) == sorted(want, key=repr)
        texts = defaultdict(set)
        for r in rows:
            texts[r[0]].add(r[1] or "")
        assert all({r.whole} == texts[r.doc_id] for r in got)
        assert {"plain", "psm", "spm"} == {r.form for r in got}
    assert fill_in_middle.fill_in_middle(frame.limit(0)).count() == 0


def test_fill_in_middle_query(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in queries.op13_fill_in_middle(spark, SF).collect()}
    assert len(got) == len(docs)
    for doc_id, text in zip(docs.doc_id, docs.text):
        n, form, a, m, out = plain_middle(doc_id, text)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert tuple(got[doc_id]) == (doc_id, n, form, a, m, sha(out), sha(text or ""))


def plain_clusters(rows, k=8, rounds=10, dims=64):
    """Python integers, one vector after the other."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) and abs(x) < 130_000 for x in v):
            kept.append((i, [int(np.floor(1024 * float(x))) for x in v]))
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in start[:k]]
    gap = lambda v, c: sum((x - y) ** 2 for x, y in zip(v, c))
    near = lambda v: min((gap(v, c), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[near(v)[1]].append(v)
        centres = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if groups[j] else c for j, c in enumerate(centres)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    inertia = defaultdict(int)
    for _, c, d in found:
        inertia[c] += d
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()) for i, c, d in found), key=repr)


def embeddings(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1.5) for i, v in rows], "vec_id long, embedding array<double>, cluster string, distance double")


def test_clusters_match_plain_rounds(spark):
    rng = np.random.default_rng(5)
    blobs = [(i, (rng.normal(size=64) * 0.1 + 3 * (i % 5)).tolist()) for i in range(900)]
    same = [(1000 + i, [0.5] * 64) for i in range(400)]  # one vector for a third of the rows
    ties = [(2000 + i, [float(i % 2)] + [0.0] * 63) for i in range(40)]
    odd = [(3000, None), (3001, []), (3002, [1.0] * 63), (3003, [1.0] * 63 + [None]), (3004, [float("nan")] * 64), (3005, [float("inf")] * 64), (3006, [1e200] * 64), (None, [0.25] * 64), (7, [0.1] * 64), (7, [0.1] * 64), (3007, [-100_000.0] * 64)]
    for rows in (blobs + same + ties + odd, blobs[:5], same[:20], [(i, (rng.normal(size=64)).tolist()) for i in range(700)]):
        got = centroids.cluster(embeddings(spark, rows)).collect()
        assert sorted((tuple(r) for r in got), key=repr) == plain_clusters(rows)
    assert centroids.cluster(embeddings(spark, [(1, None), (2, [])])).count() == 0
    assert centroids.cluster(embeddings(spark, blobs[:1]).limit(0)).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_clusters_of_another_shape(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=3).tolist()) for i in range(200)]
    got = centroids.cluster(embeddings(spark, rows), k=4, rounds=3, dims=3).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_clusters(rows, 4, 3, 3)


def test_balls_are_assigned_whole_where_clusters_lie_apart():
    """Of 2048 vectors in eight far clusters, hardly any is compared one by one; every vector is in exactly one span."""
    rng = np.random.default_rng(7)
    vectors = (rng.integers(-50, 50, (2048, 64)) + 20_000 * (np.arange(2048) % 8)[:, None]).astype(np.int64)
    ids, placed, radii, counts, sums = centroids.build(list(range(2048)), vectors)
    row = {"ids": ids, "vectors": placed, "radii": radii, "counts": counts, "sums": sums}
    spans = list(centroids.filtered(row, np.array([[20_000 * i] * 64 for i in range(8)])))
    assert sorted(x for lo, hi, _, _ in spans for x in range(lo, hi)) == list(range(2048))
    assert sum(hi - lo for lo, hi, node, _ in spans if node < 0) < 2048 / 10
    assert all((placed[lo:hi].sum(axis=0) == sums[node]).all() and counts[node] == hi - lo for lo, hi, node, _ in spans if node >= 0)


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, captured string, payload string")


ODD_PAGES = [
    (1, "http://www.example.com/a?b=1#c", "<p>one</p>", "x", "y"),
    (2, "https://example.com:443/a?b=1", "<p>one</p>", None, None),
    (9, "https://user@sub.example.co.uk", "<p>one</p>", "x", "y"),
    (3, "http://b.example/\r\nWARC-Type: evil", "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nx", "x", "y"),
    (4, None, None, "x", "y"),
    (5, "", "", "x", "y"),
    (None, "u", "<p>one</p>", "x", "y"),
    (None, "u", "alone é 語 🙂", "x", "y"),
    (6, "u?q", "z" * 400_000, "x", "y"),
    (7, "u?q", "again", "x", "y"),
    (7, "u?q", "again", "x", "y"),
    (-3, "v", "again", "x", "y"),
]


def wanted_pages(rows, least=0):
    top = {}
    for i, _, html, *_ in rows:
        top[html or ""] = max((x for x in (top.get(html or ""), i) if x is not None), default=None)
    out = []
    for i, _, html, *_ in rows:
        data = (html or "").encode()
        revisit = len(data) >= least and i != top[html or ""]
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", top[html or ""] if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [0, 8])
def test_archives_read_back(spark, tmp_path, least):
    out = web_archive.archive(pages(spark, ODD_PAGES), path=f"{tmp_path}/a", least_bytes=least, file_bytes=1000).collect()
    assert sorted((tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in out), key=repr) == wanted_pages(ODD_PAGES, least)
    assert sorted(r.position for r in out) == list(range(len(out)))
    ordered = sorted(out, key=lambda r: r.position)
    keys = [(r.url_key, r.captured, r.record_id) for r in ordered]
    assert keys == sorted(keys)
    key = {r.page_id: r.url_key for r in out}
    assert key[1] == key[2] == "com,example)/a?b=1" and key[9] == "uk,co,example,sub)/" and key[4] == key[5] == ""
    responses = {r.record_id for r in out if r.record_type == "response"}
    assert all(any(x.startswith(f"urn:page:{r.refers_to}:{r.payload_digest}") for x in responses) for r in out if r.record_type == "revisit" and r.refers_to is not None)


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_files_are_archives_on_their_own(spark, tmp_path, compression):
    """Each file parses from its first byte to its last, and a record lies where the index says."""
    out = web_archive.archive(pages(spark, ODD_PAGES), path=f"{tmp_path}/b", file_bytes=1000, compression=compression).collect()
    found = {}
    for file in (tmp_path / "b").glob("part-*"):
        for offset, head, block in web_archive.records(file.read_bytes()):
            found[(file.name, offset)] = (head["warc-record-id"].strip("<>"), len(block))
    assert len({name for name, _ in found}) > 1
    assert found == {(r.file.rsplit("/", 1)[1], r.offset): (r.record_id, r.block_bytes) for r in out}
    broken = b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n"
    with pytest.raises(ValueError):
        list(web_archive.records(broken))


def test_no_pages_and_one_payload_for_all(spark, tmp_path):
    assert web_archive.archive(pages(spark, ODD_PAGES).limit(0), path=f"{tmp_path}/c").count() == 0
    rows = [(i, "http://hot.example/", "same", None, None) for i in range(3000)]
    out = web_archive.archive(pages(spark, rows).repartition(5), path=f"{tmp_path}/d", file_bytes=2000).collect()
    assert sum(r.record_type == "response" for r in out) == 1 and {r.refers_to for r in out} == {2999, None}
    assert [r.page_id for r in sorted(out, key=lambda r: r.position)] == list(range(3000))


def test_loser_tree_merges_any_number_of_sequences():
    rng = np.random.default_rng(8)
    for k in (0, 1, 2, 3, 5, 8, 13):
        parts = [sorted(rng.integers(0, 30, rng.integers(0, 12)).tolist()) for _ in range(k)]
        merged = list(web_archive.LoserTree(parts))
        assert [parts[s][i] for s, i in merged] == sorted(x for p in parts for x in p)
        assert merged == sorted(merged, key=lambda m: (parts[m[0]][m[1]], m[0], m[1]))


def test_archive_query(spark):
    table = pd.read_parquet(f"{SF}/pages.parquet")
    got = queries.op11_warc(spark, SF).collect()
    rows = [(int(i), u, h) for i, u, h in zip(table.page_id, table.url, table.html)]
    assert sorted((tuple(r[:5]) for r in got), key=repr) == wanted_pages(rows)
