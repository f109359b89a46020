"""Operators that judge each row on its own, against plain restatements."""

import re

import brute
import pytest
from pyspark.sql import functions as F

from lifeline.llm import decontaminate, license_scan, pii_crf, quality_rules, rule_ensemble, secret_scan, sharding

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def by_text(rows):
    return sorted(rows, key=str)


def test_quality_rules(docs, rows):
    got = quality_rules.quality_rules(docs)
    assert "N_Words" not in got.columns and "score" in got.columns
    found = got.select("doc_id", *BASE, "kept", "line_chars", "clean_chars").collect()
    assert by_text((r[0], *r[1:7]) for r in found) == by_text((k, *brute.quality(t)) for k, t in rows)
    kept = {r.doc_id: r.kept for r in found}
    assert not any(kept[k] for k in (1, 2, 3, 4, 12, 17)) and kept[6]
    assert all(r.kept == (not r.base_failed and r.line_chars - r.clean_chars <= 0.3 * r.line_chars) for r in found)


def test_lines_are_cleaned_first(spark):
    lines = ["This line ends well and stays here.", "Home | News | Sport | Weather", "All rights reserved by us.",
             "no end of a sentence in here", "Menu", "This one also stays, of course.", ""]
    df = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join([lines[0] * 9, *lines]))], "doc_id long, text string")
    got = {r.doc_id: r for r in quality_rules.quality_rules(df).collect()}
    assert got[1].clean_text == lines[0] + "\n" + lines[5]
    assert (got[1].n_navigation, got[1].n_boilerplate, got[1].n_bad_punctuation, got[1].n_lines) == (2, 1, 1, 6)
    assert not got[1].kept


def test_helper_names_do_not_clash(spark, docs):
    plain = docs.select("doc_id", "text").where("doc_id < 1000")
    names = ("_text", "_Words", "_lines", "_judged", "_row", "_path", "_size", "_in", "_best", "_dir", "_near", "_clean", "_base",
             "_long", "_w", "_l", "_chars", "_digits", "__text", "digits", "Pipes", "n_lines_x")
    wide = plain.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])
    path = F.concat(F.lit("a/"), F.col("doc_id").cast("string"))
    models = secret_scan.train(spark.createDataFrame([("aB3xK9", True), ("user_name", False)], "value string, random boolean"))
    rules = rule_ensemble.Ensemble(((((0, True, 3.0), (6, False, 0.5)), 1.5),), 0.1)
    for work in (quality_rules.quality_rules, lambda d: license_scan.scan(d, path), lambda d: secret_scan.scan(d, models),
                 lambda d: rule_ensemble.score(d, rules)):
        few, many = work(plain), work(wide)
        assert set(many.columns) == set(few.columns) | set(names)
        assert by_text(many.select(*few.columns).collect()) == by_text(few.collect())
        assert {tuple(r) for r in many.select(*names).collect()} == {tuple(range(len(names)))}


def test_many_spans_of_one_text(spark):
    """Places over several blocks of matches, and long lists in linear time."""
    each = [f"x{i} {i:024x}" for i in range(20_000)]
    text = "\n".join(each)
    df = spark.createDataFrame([(1, text), (2, "\n".join(each[:64])), (3, "\n".join(each[:63])), (4, "")], "doc_id long, text string")
    got = {r.doc_id: r.hex for r in secret_scan.shaped(df, "text").select("doc_id", "hex").collect()}
    for key, n in ((1, 20_000), (2, 64), (3, 63), (4, 0)):
        assert [(s.start, s.end, s.value) for s in got[key]] == [
            (m.start(), m.end(), m.group()) for m in re.finditer("(?<![0-9a-f])[0-9a-f]{24,}", text)][:n]


def test_sharding(docs, none):
    shards = [f"s{i}" for i in range(7)]
    size = sharding.table_size(7)
    table = sharding.fill_table(shards, size)
    counts = [table.count(i) for i in range(7)]
    assert sharding.is_prime(size) and size >= 700 and max(counts) - min(counts) <= 1
    # Turn by turn, by the definition.
    taken, tried = {}, [0] * 7
    while len(taken) < size:
        for i, s in enumerate(shards):
            if len(taken) == size:
                break
            while (slot := (sharding.number(f"offset:{s}") + tried[i] * (sharding.number(f"skip:{s}") % (size - 1) + 1)) % size) in taken:
                tried[i] += 1
            taken[slot] = i
    assert [taken[k] for k in range(size)] == table
    got = sharding.place(docs, shards).collect()
    assert len(got) == docs.count() and all(table[r.slot] == r.shard for r in got)
    assert all(r.slot == sharding.number("" if r.doc_id is None else str(r.doc_id)) % size for r in got)
    assert sharding.place(none, shards).count() == 0
    fewer = sharding.fill_table(shards[:-1], size)
    moved = sum(a != b for a, b in zip(table, fewer))
    assert moved < size / 2                              # about a seventh has to move
    with pytest.raises(ValueError):
        sharding.fill_table(shards, 700)


def test_personal_data(docs, rows, none):
    field = pii_crf.train(pii_crf.BUILT_IN * 4 + [x for t, s in pii_crf.BUILT_IN * 4 for x in pii_crf.rewritten(t, s)])
    got = pii_crf.find_personal(docs, field).select("doc_id", "pii_base", "pii_spans", "N_Words").collect()
    listed = lambda spans: [f"{s.kind}:{s.start}:{s.end}" for s in spans]
    assert by_text((r.doc_id, listed(r.pii_base)) for r in got) == by_text((k, brute.personal(t)[1]) for k, t in rows)
    assert all(set(listed(r.pii_base)) <= set(listed(r.pii_spans)) for r in got)
    text = dict(rows)[15]
    added = next(r for r in got if r.doc_id == 15).pii_spans
    assert "(212) 555-0123" in [text[s.start:s.end] for s in added if s.kind == "phone"]
    assert pii_crf.find_personal(none, field).count() == 0
    assert pii_crf.default_field(none).weights.shape == field.weights.shape


def test_readings_are_best_of_all():
    """The dynamic program against every segmentation of a short zone."""
    field = pii_crf.train(pii_crf.BUILT_IN * 4)
    text = "call +1 (212) 555-0100 now"
    tokens = pii_crf.tokens_of(text, 0, len(text))
    scores = field.scores(pii_crf.segments(text, tokens))
    n = len(tokens)

    def all_readings(i, label):
        if i == n:
            yield 0.0, ()
        for j in range(i + 1, n + 1):
            if (i, j) in scores:
                for y in range(len(pii_crf.LABELS)):
                    for rest, more in all_readings(j, y):
                        yield field.steps[label, y] + scores[i, j][y] + rest, ((y, i, j), *more)
    best = max(all_readings(0, 0))
    assert [s[:3] for s in field.best(n, scores)] == [s for s in best[1] if s[0]]
    forward, backward = field.forward(n, scores), field.backward(n, scores)
    assert abs(float(pii_crf._logsum(forward[n], 0)) - backward[0, 0]) < 1e-6


def test_secrets(docs, rows, none):
    models = secret_scan.default_models(docs, sample=1000, generated=300)
    got = secret_scan.scan(docs, models).select(
        "doc_id", *[F.size(k).alias(f"n_{k}") for k in secret_scan.KINDS],
        secret_scan.joined("assign", "access", "hex").alias("base"), secret_scan.joined(*secret_scan.KINDS).alias("spans")).collect()
    assert by_text((r.doc_id, r.base) for r in got) == by_text((k, ",".join(brute.secrets(t)[1])) for k, t in rows)
    assert all(set(filter(None, r.base.split(","))) <= set(r.spans.split(",")) for r in got)
    text, row = dict(rows)[19], next(r for r in got if r.doc_id == 19)
    at = text.index("Zx8k")
    assert row.spans == f"random:{at}:{at + 22}"
    assert sum(r.n_random for r in got if r.doc_id is not None and r.doc_id >= 1000) == 0
    assert secret_scan.scan(none, secret_scan.default_models(none, generated=10)).count() == 0


def test_decontamination(spark, docs, rows, none):
    items = [(1, "the old mill and the children of the village watched it turn each"), (2, "two words"), (10, None), (11, ""),
             (3, "watched it"), (None, "alpha3 beta3 gamma3"), (4, "two words")]
    bench = spark.createDataFrame(items, "item_id long, text string").unionByName(
        spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").selectExpr("item_id + 100 AS item_id", "text"))
    listed = [(r.item_id, r.text) for r in bench.collect()]
    want = by_text(brute.contaminated(rows, listed, 10))
    for part in (1 << 24, 2_000):                        # one part, and several
        got = decontaminate.find_items(docs, bench, part_bytes=part).collect()
        assert by_text((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in got) == want
    assert decontaminate.find_items(none, bench).count() == 0
    assert decontaminate.find_items(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_licences(spark, none):
    rows = [
        (1, "a/LICENSE", "Permission is hereby granted, free of charge, under the MIT License."),
        (2, "a/b/x.py", "some code\nwithout a header"), (3, "a/b/c/y.py", "Licensed under the Apache License, Version 2.0.\n" + "some code in a line\n" * 9),
        (4, "a/b/COPYING", "This work is licensed under the GNU General Public License, version 3."), (5, "a/b/c/z.py", None),
        (6, "q/z.py", ""), (7, None, "plain"), (8, "a/n.py", "a licence of some other kind that nobody has written down"),
        (5, "a/b/c/z.py", None)]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string").withColumn("LICENCE", F.lit(1))
    got = {r.doc_id: r for r in license_scan.scan(df, F.col("path")).collect()}
    assert {k: (r.licence, r.inherited_from) for k, r in got.items()} == {
        1: ("MIT", None), 2: ("GPL-3.0", "a/b"), 3: ("Apache-2.0", None), 4: ("GPL-3.0", None), 5: ("GPL-3.0", "a/b"),
        6: (None, None), 7: (None, None), 8: ("MIT", "a")}
    assert license_scan.scan(df, F.col("path")).count() == len(rows)
    assert license_scan.scan(none, F.col("score")).count() == 0


def field_of_built_in():
    known = pii_crf.BUILT_IN * 4 + [("contact ann@example.com today", [(0, 8, 23)]), ("mail from joe@some-site.org came", [(0, 10, 27)])] * 4
    return pii_crf.train(known + [x for t, s in known for x in pii_crf.rewritten(t, s)])


def test_later_triggers_widen_a_zone():
    field, address = field_of_built_in(), "ann at example dot com"
    for n in range(3, 20):
        text = "order 123 " + "word " * n + address + " and more words follow here"
        assert address in [text[a:b] for k, a, b in pii_crf.added_spans(text, [], field) if k == 0], n


def test_addresses_of_several_labels_are_segments():
    field = field_of_built_in()
    for address in ("ann at mail dot example dot com", "ann at example dot co dot uk", "ann at a dot mail dot example dot co dot uk"):
        text = f"please write to {address} today"
        assert address in [text[a:b] for k, a, b in pii_crf.added_spans(text, [], field) if k == 0], address


def test_recall_of_held_out_forms(spark):
    """The field that the query trains, on forms, names and sentences it has not seen."""
    forms = {0: ("joe at mail dot example dot org", "ann at example dot com", "mary.jones (at) firm (dot) net",
                 "p.k (at) uni-bonn.de", "x_y at a dot co dot uk"),
             2: ("4111.1111.1111.1111", "5500.0000.0000.0004"),
             3: ("(212) 555-0123", "212-555-0123", "212.555.0123", "0171 555 0123", "0221/4567890", "415 555 0199")}
    sentences = ("please call or write to {} about it today", "contact {} now", "The reader may find {} in the third list of names.",
                 "{} is what they gave us", "Our office in Leeds ({}) opens at nine")
    others = ("it took 2024-05-06 to 2024-06-07 and 300 units", "version 10.4.200 of 12.03.2021", "more at www.example.com today 123",
              "isbn 978-3-16-148410-0 in 1999", "pages 100-200-300 at 1200", "total 1 234 567 890 of 2020",
              "they sat at the table dot 100", "sum 0 100 200 300 and 0.25 or 007")
    field = pii_crf.default_field(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    added = lambda t: pii_crf.added_spans(t, pii_crf.base_spans(t), field)
    found = [form in [text[a:b] for k, a, b in added(text) if k == kind]
             for kind, known in forms.items() for form in known for text in (s.format(form) for s in sentences)]
    assert sum(found) >= 0.9 * len(found)
    assert not any(added(t) for t in others)
