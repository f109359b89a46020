import random
import re
from collections import Counter, defaultdict

import pytest
from lifeline.llm import source_audit as auditing

SCHEMA = "text string, lang string, source string"


def brute(rows, least, top):
    counts, docs, of_lang = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for row in rows:
        text, lang, source = ("" if v is None else v for v in row)
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        counts[lang, source].update(terms)
        of_lang[lang].update(terms)
        docs[lang].update(set(terms))
    kept = {lang: sorted(t for t, n in docs[lang].items() if n >= least) for lang in docs}

    def p(counter, lang):
        total = sum(counter[t] for t in kept[lang])
        return {t: 1 + 10 ** 9 * (counter[t] + 5) // (total + 5 * len(kept[lang])) for t in kept[lang]}

    of_group = {g: p(c, g[0]) for g, c in counts.items()}
    out = []
    for (lang, source), mine in of_group.items():
        pairs = [(o, sum(abs(mine[t] - q[t]) for t in mine)) for (other, o), q in of_group.items() if other == lang and o != source]
        whole = p(of_lang[lang], lang)
        words = [(t, mine[t] - whole[t]) for t in mine if counts[lang, source][t] and mine[t] > whole[t]]
        for part, found, most in (("pair", pairs, len(pairs)), ("term", words, top)):
            found.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, item, value, i) for i, (item, value) in enumerate(found[:most], 1)]
    return sorted(out)


def run(spark, rows, least=2, top=50):
    return sorted(tuple(r) for r in auditing.audit(spark.createDataFrame(rows, SCHEMA), min_docs=least, top=top).collect())


def some_rows(n=300):
    chance = random.Random(8)
    words = ["The", "mill", "WATER", "über", "été", "Éa", "x1y", "😀", "don't", "a-b", "rare"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = [(" ".join(chance.choices(words, k=chance.randint(0, 30))), chance.choice(["en", "de", None]),
             chance.choice(["a", "b", "c", "hot", "hot", "hot", None])) for _ in range(n)]
    return rows + [(None, "en", "a"), ("", "fr", "empty"), ("", "fr", "void"), (None, None, None), ("mill " * 5000, "en", "long")] + rows[:20]


def test_against_plain_sums(spark):
    assert run(spark, some_rows()) == brute(some_rows(), 2, 50)


def test_top_terms_and_threshold(spark):
    assert run(spark, some_rows(), 30, 3) == brute(some_rows(), 30, 3)


def test_small_blocks_pieces_and_tiles(spark, monkeypatch):
    """Runs, pieces of texts and tiles end in the middle of everything."""
    rows = [(f"a{'bcdefgh'[i % 7]} mill {'xyz'[i % 3]}", "en", f"s{i % 23}") for i in range(200)]
    for name, size in (("BLOCK", 5), ("PIECE", 3), ("TILE", 4), ("TILES", 2)):
        monkeypatch.setattr(auditing, name, size)
    import pyarrow as pa
    from lifeline.llm.source_audit import corrections, runs

    table = pa.table({"lang": [r[1] for r in rows], "source": [r[2] for r in rows], "text": [r[0] for r in rows]})
    found = Counter()
    for batch in runs(iter(table.to_batches(max_chunksize=7))):
        terms = [t for t in batch.column("term").to_pylist() if t is not None]
        assert terms == sorted(terms) and len(terms) < 10 and len(set(batch.column("source").to_pylist())) == 1
        for r in batch.to_pylist():
            found[r["source"], r["term"]] += r["n"]
    want = Counter((r[2], t) for r in rows for t in re.findall("[a-z]+", r[0]))
    assert {k: n for k, n in found.items() if k[1]} == want

    chance, sums = random.Random(2), Counter()
    lists = []
    for _ in range(30):
        numbers = chance.sample(range(11), chance.randint(2, 8))
        p, p0 = [chance.randint(1, 99) for _ in numbers], [k + 1 for k in numbers]
        lists.append(("en", numbers, p, p0))
        for i, a in enumerate(numbers):
            for j, b in enumerate(numbers):
                if a < b:
                    sums[a, b] += abs(p[i] - p[j]) - abs(p[i] - p0[j]) - abs(p0[i] - p[j]) + abs(p0[i] - p0[j])
    batch = pa.RecordBatch.from_pydict({c: [r[k] for r in lists] for k, c in enumerate(("lang", "number", "p", "p0"))})
    got = Counter()
    for out in corrections(iter([batch])):
        for r in out.to_pylist():
            got[r["a"], r["b"]] += r["both"]
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in sums.items() if v}


@pytest.mark.parametrize("count, total, terms", [(0, 0, 1), (7, 900, 40), (10 ** 13, 3 * 10 ** 13, 10 ** 6), (5 * 10 ** 14, 5 * 10 ** 14, 3)])
def test_probability_is_exact(spark, count, total, terms):
    from pyspark.sql import functions as F

    row = spark.range(1).select(auditing.probability(*(F.lit(v).cast("long") for v in (count, total, terms))).alias("p")).first()
    assert row.p == 1 + 10 ** 9 * (count + 5) // (total + 5 * terms)


def test_no_rows_and_other_columns(spark):
    assert run(spark, []) == []
    rows = [(*r, 1, "x") for r in some_rows(40)]
    docs = spark.createDataFrame(rows, SCHEMA + ", n long, term string")
    assert sorted(tuple(r) for r in auditing.audit(docs, min_docs=2).collect()) == brute([r[:3] for r in rows], 2, 50)
