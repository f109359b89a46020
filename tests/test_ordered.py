"""Sliced ordered operators against plain Python, with tiny slices."""

import random

import pytest

from lifeline.operators import ordered


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(3)
    rows = []
    for host in range(4):
        for pos in sorted(rng.sample(range(400), 90 if host else 200)):
            rows.append((host, pos, rng.choice([None, rng.randrange(100)])))
    return rows, spark.createDataFrame(rows, "host_id long, pos long, v long").cache()


@pytest.mark.parametrize("width", [None, 7, 1000])
@pytest.mark.parametrize("inclusive", [True, False])
def test_running(data, width, inclusive):
    rows, df = data
    expected = set()
    for host, pos, v in rows:
        seen = [r for r in rows if r[0] == host and (r[1] < pos or (inclusive and r[1] == pos)) and r[2] is not None]
        last = max(seen, key=lambda r: r[1])[2] if seen else None
        expected.add((host, pos, last, max((r[2] for r in seen), default=None)))
    got = ordered.running(df, ["host_id"], "pos", {
        "last": "CASE WHEN v IS NOT NULL THEN struct(pos, v) END", "top": "v"}, inclusive=inclusive, width=width)
    assert set(map(tuple, got.selectExpr("host_id", "pos", "last.v", "top").collect())) == expected


@pytest.mark.parametrize("width", [5, 1000])
def test_ordinals_and_neighbours(data, width):
    rows, df = data
    got = ordered.ordinals(df, ["host_id"], "pos", "n", width)
    expected = {(h, p, sum(1 for r in rows if r[0] == h and r[1] < p)) for h, p, _ in rows}
    assert set(map(tuple, got.select("host_id", "pos", "n").collect())) == expected
    by_pos = {(h, p): v for h, p, v in rows}
    near = ordered.neighbours(df, ["host_id"], "pos", previous={"a": "v"}, following={"b": "v", "q": "pos"}, width=width)
    for r in near.collect():
        assert r["a"] == by_pos.get((r["host_id"], r["pos"] - 1))
        assert r["b"] == by_pos.get((r["host_id"], r["pos"] + 1))
        assert (r["q"] is not None) == ((r["host_id"], r["pos"] + 1) in by_pos)
    assert near.count() == len(rows)


@pytest.mark.parametrize("options", [{}, {"dense": True, "width": 9}, {"hot_rows": 100, "width": 9}])
@pytest.mark.parametrize("same", [True, False])
def test_as_of(spark, data, options, same):
    rows, df = data
    facts = spark.createDataFrame([(h, p, p * 10) for h, p, v in rows if p % 3 == 0], "host_id long, pos long, f long")
    got = ordered.as_of(df, facts, ["host_id"], "pos", "struct(f)", "found", at_same_pos=same, **options)
    for r in got.collect():
        known = [p for h, p, _ in rows if h == r["host_id"] and p % 3 == 0 and (p < r["pos"] or (same and p == r["pos"]))]
        assert (r["found"]["f"] if r["found"] else None) == (max(known) * 10 if known else None)
    assert got.columns == [*df.columns, "found"] and got.count() == len(rows)


@pytest.mark.parametrize("hot_rows", [1000, 100, 1])
def test_by_heat_takes_each_row_once(data, hot_rows):
    """One plan at every size: only the groups beyond the limit take the sliced way."""
    rows, df = data
    work = lambda part, width: ordered.running(part, ["host_id"], "pos", {"m": "v"}, width=width).selectExpr(
        "*", f"{width is not None} AS sliced")
    done = ordered.by_heat(df, ["host_id"], work, hot_rows, 4).collect()
    assert len(done) == len(rows)
    size = {h: sum(r[0] == h for r in rows) for h in range(4)}
    assert {(r["host_id"], r["sliced"]) for r in done} == {(h, n > hot_rows) for h, n in size.items()}


def test_sparse_hot_group_is_summarised_in_levels(spark):
    """Positions far apart give a slice each; summaries of summaries keep every window small."""
    rng = random.Random(6)
    places = sorted(rng.sample(range(1 << 60), 300))
    df = spark.createDataFrame([(0, p, i % 5 and i or None) for i, p in enumerate(places)], "host_id long, pos long, v long")
    got = ordered.running(df, ["host_id"], "pos", {"last": "CASE WHEN v IS NOT NULL THEN struct(pos, v) END"}, width=ordered.WIDTH)
    expected, last = [], None
    for i, p in enumerate(places):
        last = i if i % 5 else last
        expected.append((p, last))
    assert sorted((r["pos"], r["last"] and r["last"]["v"]) for r in got.collect()) == expected
    numbered = ordered.ordinals(df, ["host_id"], "pos", "n")
    assert sorted((r["pos"], r["n"]) for r in numbered.collect()) == [(p, i) for i, p in enumerate(places)]
