"""Operators over whole tables, against plain restatements and held-out rows."""

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from lifeline.llm import components, mixing, ngram_join, rule_ensemble, suffix_dedup
from lifeline.llm.store import Scratch


def by_text(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("n, percent, block", [(3, 90, 768), (5, 80, 3)])
def test_similar_groups(docs, rows, n, percent, block, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", block)      # small blocks: hot groups are cut
    got = ngram_join.similar_groups(docs, n=n, percent=percent, slots=1 << 10).collect()
    assert by_text((r.id, r.n_shingles, r.component) for r in got) == by_text(brute.components(rows, n, percent))


def test_no_documents(none):
    assert ngram_join.similar_groups(none).count() == 0
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_prefix_tree_finds_all_pairs():
    shape, draw = ngram_join.Shape(3, 80), random.Random(3)
    base = [np.array(sorted(draw.sample(range(4000), 60)), np.uint64) for _ in range(6)]
    sets = []
    for i in range(90):
        s = set(base[i % 6].tolist())
        for _ in range(draw.randrange(0, 12)):
            s.discard(draw.choice(sorted(s)))
            s.add(draw.randrange(4000))
        sets.append(np.array(sorted(s), np.uint64))
    tree = ngram_join.PrefixTree(sets, shape)
    for i, probe in enumerate(tree.sequences):
        want = {j for j, s in enumerate(tree.sequences)
                if (c := len(np.intersect1d(probe, s))) * 180 >= 80 * (len(probe) + len(s))}
        assert set(tree.similar(probe, np.zeros(len(sets), bool))) == want


def family(size: int, parted: int) -> list[np.ndarray]:
    """A set and copies of it in which so many percent of the elements are their own: copies are not similar to each other."""
    draw, base = np.random.default_rng(4), np.arange(300, dtype=np.uint64)
    own = [np.concatenate([draw.permutation(base)[300 * parted // 100:], 1000 * (i + 1) + np.arange(3 * parted, dtype=np.uint64)]) for i in range(size)]
    return [np.sort(x).astype(np.uint64) for x in [base, *own]]


def test_matrices_of_bitmaps_bound_as_pairs_do():
    shape, draw = ngram_join.Shape(3, 80), np.random.default_rng(6)
    sets = [np.unique(draw.integers(0, 150, draw.integers(1, 220)).astype(np.uint64)) for _ in range(60)] + family(40, 11)
    maps, sizes = [ngram_join.bitmap(x) for x in sets], [len(x) for x in sets]
    bounds, whole = ngram_join.Bitmaps(maps, sizes, shape), [(int.from_bytes(m, "little"), 8 * len(m), n) for m, n in zip(maps, sizes)]
    for i, x in enumerate(whole):
        free = draw.integers(0, 2, len(sets)).astype(bool)
        want = {j for j in np.flatnonzero(free).tolist()
                if (need := shape.overlap(sizes[i], sizes[j])) <= min(sizes[i], sizes[j], ngram_join.most_common(*x, *whole[j]))}
        assert set(bounds.allow(i, free).tolist()) == want
    near = {i: set(bounds.allow(i, np.ones(len(sets), bool)).tolist()) for i in range(len(sets))}
    for i, root in enumerate(bounds.parts()):
        reached, todo = {i}, [i]
        while todo:
            more = near[todo.pop()] - reached
            reached |= more
            todo += more
        assert root == min(reached)


def test_large_group_of_sets_that_are_apart(monkeypatch):
    """Copies that differ from each other are not compared one by one in the tree."""
    shape, calls, similar = ngram_join.Shape(5, 80), [], ngram_join.PrefixTree.similar

    def counted(self, probe, skip):
        calls.append(1)
        return similar(self, probe, skip)

    monkeypatch.setattr(ngram_join.PrefixTree, "similar", counted)
    for parted, linked in ((10, 200), (14, 0)):           # ten percent: similar to the first set only
        calls.clear()
        links = ngram_join.forest(list(range(201)), family(200, parted), shape)
        assert len(links) == len({a for a, _ in links}) == linked
    assert len(calls) <= 50


def test_bitmaps_never_understate():
    draw = np.random.default_rng(5)
    for _ in range(200):
        a, b = (np.unique(draw.integers(0, 300, draw.integers(1, 200)).astype(np.uint64)) for _ in range(2))
        maps = [(int.from_bytes(ngram_join.bitmap(x), "little"), 8 * len(ngram_join.bitmap(x)), len(x)) for x in (a, b)]
        assert ngram_join.most_common(*maps[0], *maps[1]) >= len(np.intersect1d(a, b))


def test_components(spark):
    draw = random.Random(9)
    links = [(draw.randrange(400), draw.randrange(400)) for _ in range(300)] + [(i, i + 1) for i in range(1000, 1200)] + [(None, 3), (5, 5)]
    scratch = Scratch(spark, "test")
    got = {r.node: r.root for r in components.connected(spark.createDataFrame(links, "a long, b long"), scratch).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x
    for a, b in links:
        if a is not None and a != b:
            lo, hi = sorted((find(a), find(b)))
            root[hi] = lo
    assert got == {x: find(x) for x in root}
    scratch.close()


@pytest.mark.parametrize("group", [20_000, 2])
def test_repeats(docs, rows, group, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)    # small groups: strings are dealt out by name
    short = docs.where("doc_id IS NULL OR doc_id <> 16")
    got = suffix_dedup.remove_repeats(short, with_rest=True).collect()
    want = brute.repeats([r for r in rows if r[0] != 16], 200)
    assert by_text((r.id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == by_text(want)
    assert all(r.rest is None or brute.sha(bytes(r.rest)) == r.kept_sha256 for r in got)


def test_repeat_runs(spark):
    texts = ["a" * 1000, "ab" * 500, "x" * 199, "é" * 300, "left " + "q" * 30 + "a" * 200]
    rows = list(enumerate(texts))
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute.repeats(rows, 200)


def test_rule_ensemble(docs, labels, none):
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    ensemble = rule_ensemble.train(docs, labels, ~held_out)
    got = rule_ensemble.score(docs, ensemble)
    assert "N_Words" not in got.columns and got.where("score BETWEEN 0 AND 1").count() == docs.count()
    judged = got.join(labels.where("quality IS NOT NULL"), "doc_id").where(held_out).select("score", "quality").collect()
    assert np.mean([(r.score >= 0.7) == r.quality for r in judged]) >= 0.9
    assert rule_ensemble.score(none, ensemble).count() == 0
    alone = rule_ensemble.train(none, labels, ~held_out)
    assert {r.score for r in rule_ensemble.score(docs, alone).collect()} == {0.5}


def test_compiled_score_is_the_models(spark):
    x = np.random.default_rng(1).random((400, len(rule_ensemble.FEATURES)))
    y = ((x[:, 0] > 0.5) & (x[:, 3] <= 0.6)).astype(float)
    ensemble = rule_ensemble.fit(x, y)
    df = spark.createDataFrame([tuple(map(float, r)) for r in x[:50]], list(rule_ensemble.FEATURES))
    got = [r[0] for r in df.select(ensemble.score()).collect()]
    want = [1 / (1 + np.exp(-(ensemble.bias + sum(w * rule_ensemble.holds(r, x[i:i + 1])[0] for r, w in ensemble.rules)))) for i in range(50)]
    assert np.allclose(got, want) and np.mean((np.array(want) > 0.5) == y[:50]) > 0.9


def test_mixing(docs, labels, none):
    domains, shares = (("1", "0"), ("1", "1"), ("0", "0"), ("0", "1")), (0.9, 0.03, 0.06, 0.01)
    model = mixing.train(docs, labels, ("quality", "toxic"), domains)
    got = mixing.mix(docs, model, shares).collect()
    tokens, rate = np.array([r.n_tokens for r in got]), np.array([r.rate for r in got])
    p = np.array([r.posterior for r in got])
    assert len(got) == docs.count() and (rate >= 0).all() and np.allclose(p.sum(axis=1), 1)
    assert sorted(tokens) == sorted(len(brute.WORD.findall(r.text or "")) for r in docs.collect())
    there = tokens @ p / tokens.sum()
    wanted = np.minimum(there, there[0] / 0.9 * np.array(shares))
    # The same least squares, solved on the driver by many plain steps.
    plain = np.ones(len(tokens))
    for _ in range(40):
        error = (tokens * plain) @ p / tokens.sum() - wanted
        if np.abs(error).max() <= 1e-4:
            break
        plain = np.maximum(0, plain - p @ (error / there))
    assert np.allclose(plain, rate) and np.abs((tokens * rate) @ p / tokens.sum() - wanted).max() < 2e-3
    assert mixing.mix(none, model, shares).count() == 0
    blank = mixing.train(none, labels, ("quality", "toxic"), domains)
    assert not blank.weights.any()


def test_scarce_domains_are_repeated_to_meet_their_shares(spark):
    """Four documents in a hundred are of a domain that a tenth of the tokens is wanted of."""
    schema = "doc_id long, text string"
    df = spark.createDataFrame([(i, ("rare " if i % 25 == 0 else "plain ") * 20) for i in range(4000)], schema)
    labels = df.selectExpr("doc_id", "CAST(doc_id % 25 = 0 AS INT) AS rare")
    model = mixing.train(df, labels, ("rare",), (("0",), ("1",)))
    mixed = mixing.mix(df, model, (0.9, 0.1), keep_text=True)
    got = mixed.collect()
    rates, copies = np.array([r.rate for r in got]), np.array([r.copies for r in got])
    assert all(r.taken == (r.copies > 0) and abs(r.copies - r.rate) < 1 for r in got)
    p, tokens = np.array([r.posterior for r in got]), np.array([r.n_tokens for r in got])
    fitted, reached = (tokens * rates) @ p, (tokens * copies) @ p
    assert abs(fitted[1] / fitted.sum() - 0.1) < 1e-3 and abs(reached[1] / reached.sum() - 0.1) < 0.01
    rows = mixing.drawn(mixed)
    assert rows.columns == ["doc_id", "text"] and rows.count() == copies.sum()
    with pytest.warns(UserWarning, match="out of reach"):
        mixing.fit_rates(mixed, (0.8, 0.2), rounds=3)
