"""Joins in the plane, communications and events of many causes against plain versions."""

from collections import defaultdict, deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewave.functions import planar
from tidewave.operators import communications, graph, spatial


def points(rng, n, spread):
    rows = [(i, "ab"[i % 2], int(rng.integers(0, 40)), float(rng.normal() * spread), float(rng.normal() * spread)) for i in range(n)]
    return rows + [(n, "a", 3, float("nan"), 0.0), (n + 1, "a", 3, None, 0.0), (n + 2, "b", 3, float("inf"), float("inf")), (n + 3, "a", 3, 1e300, 1e300)]


def finite(r):
    return r[3] is not None and np.isfinite(r[3]) and abs(r[3]) < 1e200


@pytest.mark.parametrize("full", [5, 4096])
@pytest.mark.parametrize("spread", [0.5, 30.0])
def test_within_equals_all_pairs(spark, spread, full):
    rng = np.random.default_rng(1)
    left, right = points(rng, 150, spread), points(rng, 170, spread)
    a = spark.createDataFrame(left, "a long, k string, t long, x double, y double")
    b = spark.createDataFrame(right, "b long, k string, t2 long, x2 double, y2 double")
    radius = 10.0
    near = {(p[0], q[0]) for p in left for q in right if finite(p) and finite(q) and (p[3] - q[3]) ** 2 + (p[4] - q[4]) ** 2 <= radius**2}
    assert {(r.a, r.b) for r in spatial.within(a.drop("k", "t"), b.drop("k", "t2"), radius, full=full).collect()} == near
    met = spatial.within(a, b, radius, keys=["k"], times=("t", "t2"), lag=(-2, 5), full=full)
    got = [(r.a, r.b) for r in met.collect()]
    key = {**{("a", p[0]): p for p in left}, **{("b", q[0]): q for q in right}}
    want = {(i, j) for i, j in near if key[("a", i)][1] == key[("b", j)][1] and -2 <= key[("b", j)][2] - key[("a", i)][2] <= 5}
    assert len(got) == len(set(got)) and set(got) == want
    with pytest.raises(ValueError):
        spatial.within(a, b, 0.0)


def test_points_exactly_one_radius_apart_meet(spark):
    radius = 0.1
    rows = [(i, i * radius, 0.0) for i in range(-300, 300)]
    a = spark.createDataFrame(rows, "cell long, x double, y double")
    want = {(i, j) for i, x, _ in rows for j, z, _ in rows if i != j and (x - z) * (x - z) <= radius**2}
    assert {(r.cell, r.other) for r in spatial.near(a, radius).collect()} == want


def test_a_heap_in_one_square_is_split_and_no_pair_is_made_by_a_loop(spark):
    """Of 10,000 points in one square and frame, each part that meets the left side holds a bounded share."""
    heap = spark.range(10_000).select(F.col("id").alias("b"), F.lit(0).cast("long").alias("t2"), (F.col("id") / 1e6).alias("x2"), F.lit(0.5).alias("y2"))
    asked = spark.createDataFrame([(i, 0, i * 1e-4, 0.5) for i in range(30)], "a long, t long, x double, y double")
    met = spatial.within(asked, heap, 1.0, times=("t", "t2"), lag=(0, 3), full=512)
    assert met.count() == 30 * 10_000
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    parts = F.ceil(F.lit(10_000) / 512).cast("int")
    sizes = [r["count"] for r in heap.groupBy(F.pmod(F.xxhash64("b", "t2", "x2", "y2"), parts)).count().collect()]
    assert len(sizes) == 20 and max(sizes) < 2 * 512


def test_neighbour_lists(spark):
    a = spark.createDataFrame([(3, 0.0, 0.0), (1, 1.0, 0.0), (2, 0.0, 1.0), (9, 50.0, 50.0), (8, None, 0.0)], "cell long, x double, y double")
    assert {r.cell: (r.neighbours, r.n_neighbours) for r in spatial.neighbour_lists(a, 1.0).collect()} == {3: ([1, 2], 2), 1: ([3], 1), 2: ([3], 1), 9: ([], 0), 8: ([], 0)}


def plain_metrics(arcs):
    arcs = set(arcs)
    nodes = {x for arc in arcs for x in arc}
    after = defaultdict(list)
    for a, b in arcs:
        after[a].append(b)
    roots = nodes - {b for _, b in arcs}
    leaves = nodes - set(after)
    width, paths = defaultdict(int), []
    for root in roots:
        far, queue = {root: 0}, deque([root])
        while queue:
            x = queue.popleft()
            for y in after[x]:
                if y not in far:
                    far[y] = far[x] + 1
                    queue.append(y)
        for x, s in far.items():
            width[s] += 1
            if x in leaves:
                paths.append(s)
    inner = [x for x in nodes if after[x]]
    return (len(nodes), len(arcs), len(roots), max(paths, default=0), max(width.values(), default=1), round(len(arcs) / len(inner), 3), round(sum(paths) / len(paths), 3) if paths else 0.0)


def test_dag_metrics_of_several_causes_cycles_and_missing_roots(spark):
    rng = np.random.default_rng(2)
    graphs = {
        1: [(1, 2), (1, 3), (2, 4), (3, 4)],  # a diamond
        2: [(1, 2), (2, 3), (3, 1)],  # a cycle, no root and no leaf
        3: [(9, 1), (1, 2), (2, 3), (3, 1), (3, 7)],  # a cycle behind a root
        4: [(1, 5), (2, 5), (3, 5), (5, 6), (6, 7), (2, 7)],  # three roots
        5: [(1, 2), (1, 2), (2, 1)],
    }
    for e in range(6, 20):
        graphs[e] = [(int(a), int(b)) for a, b in rng.integers(0, 12, (14, 2)) if a != b]
    frame = spark.createDataFrame([(e, a, b) for e, arcs in graphs.items() for a, b in arcs], "event long, a long, b long")
    got = {r.event: tuple(r[1:]) for r in communications.dag_metrics(frame).collect()}
    assert got == {e: plain_metrics(arcs) for e, arcs in graphs.items()}


def test_origin_is_the_first_root_or_the_first_cell(spark):
    rows = [(1, 5, 6, 10, 11), (1, 4, 6, 9, 11), (2, 7, 8, 3, 4), (2, 8, 7, 4, 6), (3, 1, 2, 5, 5), (3, 0, 2, 5, 5)]
    links = spark.createDataFrame(rows, "event long, cause_cell long, cell long, cause_frame long, frame long")
    assert sorted(tuple(r) for r in communications.origins(links).collect()) == [(1, 4, True), (2, 7, False), (3, 0, True)]


def plain_communications(peaks, edges, reach):
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
    pairs = defaultdict(set)
    for p in peaks:
        for q in peaks:
            if q[1] in near[p[1]] and p[2:4] == q[2:4]:
                pairs[p[0]].add(q[0])
    by_id, seen, links = {p[0]: p for p in peaks}, set(), set()
    for start in sorted(pairs):
        if start in seen:
            continue
        group, todo = {start}, [start]
        while todo:
            for y in pairs[todo.pop()] - group:
                group.add(y)
                todo.append(y)
        seen |= group
        cells = {by_id[i][1] for i in group}
        frame, dataset = by_id[start][3], by_id[start][2]
        outside = [(q[3], q[1], q[0]) for q in peaks if q[2] == dataset and q[1] not in cells and any(q[1] in near[c] for c in cells) and frame - reach <= q[3] < frame]
        if outside:
            _, cell, source = min(outside)
            level = {i for i in group if cell in near[by_id[i][1]]}
            links |= {(source, i) for i in level}
        else:
            level = {min(group, key=lambda i: (by_id[i][1], i))}
        found = set(level)
        while level:
            reached = {y for x in level for y in pairs[x]} - found
            links |= {(min((x for x in level if y in pairs[x]), key=lambda x: (by_id[x][1], x)), y) for y in reached}
            found |= reached
            level = reached
    for p in peaks:
        if p[0] not in seen:
            back = [(q[3], q[0]) for q in peaks if q[2] == p[2] and q[1] in near[p[1]] and p[3] - reach <= q[3] < p[3]]
            if back:
                links.add((min(back)[1], p[0]))
    return links


def test_communications_and_their_events(spark):
    rng = np.random.default_rng(3)
    cells = 14
    edges = {(a, b) for a in range(cells) for b in range(cells) if a != b and abs(a - b) in (1, 3)}
    peaks = [(i, int(rng.integers(0, cells)), "ab"[int(rng.integers(0, 2))], int(rng.integers(0, 40))) for i in range(220)]
    p = spark.createDataFrame(peaks, "event_id long, cell long, dataset string, frame long")
    e = spark.createDataFrame(sorted(edges), "cell long, neighbour long")
    links = communications.communications(p, e, 6)
    got = [(r.cause_id, r.event_id) for r in links.collect()]
    want = plain_communications(peaks, edges, 6)
    assert len(got) == len(set(got)) and set(got) == want
    label = {i: i for i, *_ in peaks}

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in want:
        a, b = top(a), top(b)
        label[max(a, b)] = min(a, b)
    size = defaultdict(set)
    for a, b in want:
        size[top(a)] |= {a, b}
    events = {(r.event, r.cause_id, r.event_id) for r in communications.events(links, 3).collect()}
    assert events == {(top(a), a, b) for a, b in want if len(size[top(a)]) >= 3}


def test_communications_within_a_radius_need_no_edges(spark):
    rng = np.random.default_rng(5)
    at = {c: (float(rng.uniform(0, 8)), float(rng.uniform(0, 8))) for c in range(16)}
    edges = {(a, b) for a in at for b in at if a != b and (at[a][0] - at[b][0]) ** 2 + (at[a][1] - at[b][1]) ** 2 <= 4.0}
    peaks = [(i, int(rng.integers(0, 16)), "ab"[int(rng.integers(0, 2))], int(rng.integers(0, 40))) for i in range(220)]
    p = spark.createDataFrame([(*q, *at[q[1]]) for q in peaks], "event_id long, cell long, dataset string, frame long, x double, y double")
    got = [(r.cause_id, r.event_id) for r in communications.communications(p, None, 6, 2.0).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_communications(peaks, edges, 6)


def test_copies_over_squares_are_not_broadcast(spark):
    p = spark.range(1000).select(F.col("id").alias("a"), F.col("id").alias("t"), F.lit(0.5).alias("x"), F.lit(0.5).alias("y"))
    met = spatial.within(p, p.toDF("b", "t2", "x2", "y2"), 1.0, times=("t", "t2"), lag=(1, 6))
    top = met._jdf.queryExecution().sparkPlan().toString().split("Join", 1)[0]
    assert "SortMerge" in top and "Broadcast" not in top


def test_components_of_long_paths_take_few_rounds(spark, monkeypatch):
    """Labels that only flow along links need a round a step where a path climbs and falls again."""
    cuts = []
    monkeypatch.setattr(graph, "cut", lambda df, kept=graph.cut: cuts.append(1) or kept(df))
    n = 600
    name = [int(x) for x in np.random.default_rng(6).permutation(n)]
    name = [x + 1000 * (i % 40) for i, x in enumerate(name)]
    links = [(name[i], name[i + 1]) for i in range(n - 1)] + [(90_000, 90_001), (90_001, 90_000), (90_002, 90_002)]
    got = {r.node: r.label for r in graph.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{x: min(name) for x in name}, 90_000: 90_000, 90_001: 90_000, 90_002: 90_002}
    assert len(cuts) <= 12


def test_components_write_tables_that_shrink(spark, monkeypatch):
    """Chains in order, stars and random links: right labels, and all rounds together write few rows for each node."""
    rng = np.random.default_rng(5)
    chain = [(i, i + 1) for i in range(3000)]
    star = [(5000, 5001 + i) for i in range(500)]
    loose = [(int(a), int(b)) for a, b in rng.integers(6000, 7000, (700, 2))] + [(9000, 9000)]
    label = {n: n for link in chain + star + loose for n in link}
    changed = True
    while changed:
        changed = False
        for a, b in chain + star + loose:
            low = min(label[a], label[b])
            changed |= (label[a], label[b]) != (low, low)
            label[a] = label[b] = low
    written, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: written.append(out := cut(df)) or out)
    monkeypatch.setattr(graph, "release", lambda *tables: None)
    found = {r["node"]: r["label"] for r in graph.connected(spark.createDataFrame(chain + star + loose, "a long, b long")).collect()}
    assert found == label
    assert sum(t.count() for t in written) < 9 * len(label)


def test_distances_of_long_paths_take_few_rounds(spark, monkeypatch):
    rng = np.random.default_rng(11)
    edges = {(1, i, i + 1) for i in range(60)} | {(2, 7, 8), (2, 8, 7), (2, 6, 7)} | {(3, int(a), int(b)) for a, b in rng.integers(0, 30, (45, 2)) if a != b}
    out, into = defaultdict(set), {(e, b) for e, _, b in edges}
    for e, a, b in edges:
        out[e, a].add(b)
    starts = sorted({(e, a) for e, a, _ in edges} - into)
    want = set()
    for e, r in starts:
        seen, level, steps = {r}, {r}, 0
        while level:
            want |= {(e, r, x, steps) for x in level}
            level = {y for x in level for y in out[e, x]} - seen
            seen, steps = seen | level, steps + 1
    arcs, roots = spark.createDataFrame(sorted(edges), "event long, a long, b long"), spark.createDataFrame(starts, "event long, root long")
    cuts = []
    monkeypatch.setattr(graph, "cut", lambda df, cut=graph.cut: cuts.append(1) or cut(df))
    assert {tuple(r) for r in graph.distances(roots, arcs).collect()} == want
    assert len(cuts) <= 4
    # Event 1 alone has 60 edges times roots, and takes a job a step.
    assert {tuple(r) for r in graph.distances(roots, arcs, 59).collect()} == want


def test_dense_peaks_do_not_look_back_over_the_whole_reach(spark, monkeypatch):
    peaks = [(100 * f + c, c, "a", f, float(10 * (c // 2)), 0.0) for f in range(12) for c in range(8) if (f + c) % 3]
    at = {c: float(10 * (c // 2)) for c in range(8)}
    edges = {(a, b) for a in at for b in at if a != b and abs(at[a] - at[b]) <= 2}
    met = []
    within = spatial.within

    def counted(left, right, radius, **k):
        pairs = within(left, right, radius, **k)
        met.append((k["lag"], pairs.count()))
        return pairs

    monkeypatch.setattr(spatial, "within", counted)
    p = spark.createDataFrame(peaks, "event_id long, cell long, dataset string, frame long, x double, y double")
    got = [(r.cause_id, r.event_id) for r in communications.communications(p, None, 5, 2.0).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_communications(peaks, edges, 5)
    assert {lag for lag, _ in met} == {(0, 0), (-5, -5), (-4, -1)}


@pytest.mark.parametrize("reach", [1, 6])
def test_frames_taken_whole_write_no_pairs(spark, monkeypatch, reach):
    """Communications of crowded frames are those of the plain loop, and no table between the steps is longer than the peaks."""
    for seed, spread, cells, frames in ((5, 8, 16, 40), (6, 30, 60, 12), (7, 4, 25, 10)):
        rng = np.random.default_rng(seed)
        at = {c: (float(rng.uniform(0, spread)), float(rng.uniform(0, spread))) for c in range(cells)}
        at[3] = (float("nan"), 0.0)
        edges = {(a, b) for a in at for b in at if a != b and (at[a][0] - at[b][0]) ** 2 + (at[a][1] - at[b][1]) ** 2 <= 4.0}
        ids = rng.permutation(300) + (1 << 60)
        peaks = [(int(i), int(rng.integers(0, cells)), "ab"[int(rng.integers(0, 2))], int(rng.integers(0, frames))) for i in ids]
        p = spark.createDataFrame([(*q, *at[q[1]]) for q in peaks], "event_id long, cell long, dataset string, frame long, x double, y double")
        written, cut = [], graph.cut
        monkeypatch.setattr(communications, "FEW", 0)
        monkeypatch.setattr(graph, "cut", lambda df: (lambda t: written.append(t.count()) or t)(cut(df)))
        found = [tuple(r) for r in communications.communications(p, None, reach, 2.0).collect()]
        monkeypatch.setattr(graph, "cut", cut)
        by_id = {q[0]: q for q in peaks}
        assert len(found) == len({r[:2] for r in found}) and {r[:2] for r in found} == plain_communications(peaks, edges, reach)
        assert all((by_id[a][1], by_id[b][1], by_id[b][2], by_id[a][3], by_id[b][3]) == tuple(rest) for a, b, *rest in found)
        assert max(written) <= 300


def test_followers_and_flags_of_peaks_need_no_shuffle_of_pairs(spark):
    rng = np.random.default_rng(21)
    for spread in (4, 40):
        rows = [(i, "ab"[i % 2], int(rng.integers(-20, 40)), *map(float, rng.uniform(0, spread, 2))) for i in range(300)] + [(900, "a", 3, float("nan"), 0.0)]
        p = spark.createDataFrame(rows, "event_id long, dataset string, frame long, x double, y double")
        found = spatial.followers(p, 3.0, 6)
        want = {(a[0], b[0], b[2] - a[2]) for a in rows for b in rows if a[1] == b[1] and 1 <= b[2] - a[2] <= 6 and (a[3] - b[3]) ** 2 + (a[4] - b[4]) ** 2 <= 9}
        got = [(r.a_id, r.b_id, r.lag) for r in found.collect()]
        assert len(got) == len(set(got)) and set(got) == want
        assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0
        own = sorted((r for r in rows if r[1] == "a"), key=lambda r: r[2])
        met, caused = planar.flags(np.array([r[3:] for r in own]), np.array([r[2] for r in own]), 3.0, 6)
        ends = {i for a, b, _ in want for i in (a, b)}
        assert {r[0] for r, f in zip(own, met) if f} == {r[0] for r in own} & ends
        assert {r[0] for r, f in zip(own, caused) if f} == {r[0] for r in own} & {b for _, b, _ in want}


@pytest.mark.parametrize("full", [7, 4096])
def test_neighbour_lists_shuffle_no_pairs(spark, full):
    rng = np.random.default_rng(22)
    rows = [(i, *map(float, rng.normal(size=2) * s)) for i, s in zip(rng.permutation(200) + (1 << 55), [3.0, 60.0] * 100)] + [(5, float("nan"), 0.0), (6, None, 1.0), (7, 1e300, 0.0)]
    rows = [(int(c), x, y) for c, x, y in rows]
    found = spatial.neighbour_lists(spark.createDataFrame(rows, "cell long, x double, y double"), 4.0, full)
    near = lambda p, q: p[0] != q[0] and finite((0, 0, 0, *p[1:])) and finite((0, 0, 0, *q[1:])) and (p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2 <= 16
    want = {p[0]: sorted(q[0] for q in rows if near(p, q)) for p in rows}
    got = found.collect()
    assert len(got) == len(rows) and {r.cell: r.neighbours for r in got} == want and all(r.n_neighbours == len(r.neighbours) for r in got)
    assert "collect_set" not in found._jdf.queryExecution().optimizedPlan().toString()
