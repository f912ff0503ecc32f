"""Quality, vector codes and collocations against brute force and over difficult rows."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from gridloom.llm import codes, collocations, quality
from tests.test_queries import SF, canonical

DOCS = "doc_id long, text string, lang string, source string, f long, phrase string, w string, a string, rank string, id string, x string, y string, kind string"
VECTORS = "vec_id long, embedding array<double>, label int, id string, v string, code string, n string, of string"


def docs_of(spark, rows):
    return spark.createDataFrame([(d, t, lang, "s", 9, *["z"] * 8) for d, t, lang in rows], DOCS)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    vocabulary = ["The", "of", "Zürich", "new", "york", "x-ray", "日本", "é", "a b".replace(" ", "\t"), "q"]
    out = []
    for i in range(120):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([0, 5, 60]))]
        out.append((i, " ".join(w + rng.choice(["", "", "", ".", "!", ",\n", "  ", "\x0b"]) for w in words), rng.choice(["en", "de", None, "und"])))
    out += [(200, None, "en"), (201, "", None), (202, " \t\n ", "en"), (3, "new york new york", "en"), (3, "new york new york", "en"), (None, "new york of the", "en")]
    return out + [(300, "new york city. " * 20_000, "hot"), (301, "ab " * 100_000 + "cd", "hot")]


def brute_collocations(rows, max_n=3, least=10, contained=50, top=2000):
    counts = defaultdict(Counter)
    for _, text, lang in rows:
        low = (text or "").translate(str.maketrans(collocations.UPPER, collocations.LOWER))
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            for n in range(1, max_n + 1):
                counts[lang if lang is not None else "und"].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, f in counts.items():
        total = sum(v for p, v in f.items() if len(p) == 1)
        candidates = {p: v for p, v in f.items() if len(p) > 1 and v >= least}
        inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        kept = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and inside(p, q) and 100 * v >= contained * a for q, v in candidates.items()):
                continue
            score, _, l_, r = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), l_, r))
        out += [(lang, i, p.decode(), -a, l_, r, total, -s) for i, (s, a, p, l_, r) in enumerate(sorted(kept)[:top], 1)]
    return Counter(out)


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


@pytest.mark.parametrize("options", [{}, {"max_n": 4, "least": 5, "contained": 80, "top": 7}, {"max_n": 2}])
def test_collocations(spark, rows, options):
    got = collocations.collocations(docs_of(spark, rows).repartition(5), **options)
    assert got.columns == COLUMNS
    assert Counter(tuple(r) for r in got.collect()) == brute_collocations(rows, **options)


def test_collocations_over_chunks(spark, rows, monkeypatch):
    monkeypatch.setattr(collocations, "CHUNK", 40)
    assert Counter(tuple(r) for r in collocations.collocations(docs_of(spark, rows[:120])).collect()) == brute_collocations(rows[:120])


def test_collocations_of_nothing(spark):
    assert collocations.collocations(docs_of(spark, [])).count() == 0
    assert collocations.collocations(docs_of(spark, [(1, None, None), (2, "one two", "en")])).count() == 0


def test_large_products_are_exact(spark):
    a = 10**16 - 1
    row = spark.createDataFrame([(a, a, a - 1)], "a long, l long, r long")
    got = row.selectExpr("cast(cast(cast(a as decimal(16,0)) * cast(a as decimal(16,0)) as decimal(32,0)) * 1000000bd as decimal(38,0)) div cast(cast(l as decimal(16,0)) * cast(r as decimal(16,0)) as decimal(32,0)) as s").first()["s"]
    assert got == 1000000 * a * a // (a * (a - 1))


def brute_codes(rows, entries=256, parts=4, rounds=4):
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    first = {}
    for i, v, _ in kept:
        if i is not None and v:
            first[i] = min(first.get(i, v), v)
    start = [first[i] for i in sorted(first) if first[i]][:entries]
    start = [v for v in start if len(v) == len(start[0])]
    width = len(start[0]) // parts
    books = [[v[p * width : (p + 1) * width] for v in start] for p in range(parts)]
    fit = [r for r in kept if len(r[1]) == len(start[0])]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def nearest(v, p):
        part = v[p * width : (p + 1) * width]
        return min((dist(part, e), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        new = [list(b) for b in books]
        for p in range(parts):
            members = defaultdict(list)
            for _, v, _ in fit:
                members[nearest(v, p)[1]].append(v[p * width : (p + 1) * width])
            for k, m in members.items():
                new[p][k] = [sum(c) // len(m) for c in zip(*m, strict=True)]
        books = new
    out, total = [], Counter()
    for i, v, label in kept:
        found = [nearest(v, p) for p in range(parts)] if len(v) == len(start[0]) else None
        out.append((i, "".join(f"{k:02x}" for _, k in found) if found else None, sum(d for d, _ in found) if found else None, label))
        total[label] += out[-1][2] or 0
    told = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return Counter((i, c, e, total[label], told) for i, c, e, label in out)


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, label, *["z"] * 5) for i, v, label in rows], VECTORS).repartition(3)


def coded(df, **options):
    return Counter(tuple(r) for r in codes.compress(df, **options).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())


@pytest.mark.parametrize("entries", [2, 24, 256])
def test_vector_codes(spark, entries):
    rng = random.Random(12)
    rows = [(i, [rng.choice([rng.gauss(0, 1), 0.5, -0.25]) for _ in range(8)], rng.choice([0, 0, 0, 1, None])) for i in range(150)]
    rows += [(500 + i, rows[i][1], 0) for i in range(40)] + [rows[3], rows[3], (None, rows[4][1], 1), (3, rows[9][1], 7)]
    rows += [(600, None, 0), (601, [0.1, None, *[0.0] * 6], 0), (602, [float("nan"), *[0.0] * 7], 0), (603, [float("inf"), *[0.0] * 7], None), (604, [1e5, *[-1e5] * 7], 3)]
    assert coded(vectors_of(spark, rows), entries=entries) == brute_codes(rows, entries)


def test_vector_codes_of_odd_tables(spark):
    assert not coded(vectors_of(spark, []))
    assert not coded(vectors_of(spark, [(1, None, 2), (None, [1.0] * 8, 2)]))
    rows = [(1, [0.5] * 8, None), (2, [0.5] * 4, 1), (3, [], 1), (4, [0.25] * 8, 1)]
    assert coded(vectors_of(spark, rows)) == brute_codes(rows)
    with pytest.raises(ValueError):
        codes.compress(vectors_of(spark, [(1, [0.5] * 6, None)]))


def test_ball_tree_visits_ties_and_finds_the_nearest():
    rng = np.random.default_rng(1)
    for spread in (2, 1000, 1 << 27):
        entries, points = rng.integers(-spread, spread, (200, 16)), rng.integers(-spread, spread, (400, 16))
        d = ((points[:, None].astype(object) - entries.astype(object)) ** 2).sum(axis=2)
        at, best = codes.BallTree(entries).nearest(points)
        assert [int(x) for x in best] == [min(r) for r in d.tolist()] and [int(x) for x in at] == [r.index(min(r)) for r in d.tolist()]


def test_label_errors_of_hot_and_rare_labels(spark, monkeypatch):
    monkeypatch.setattr(codes, "HOT", 4)
    rows = [(i, 0 if i < 60 else i, "c", i) for i in range(100)] + [(200, None, "c", 5), (201, None, "c", 6)]
    want = Counter()
    for _, label, _, e in rows:
        want[label] += e
    got = codes.with_label_error(spark.createDataFrame(rows, "id long, label int, code string, error long")).collect()
    assert len(got) == len(rows) and all(r["label_error"] == want[r["label"]] for r in got)


@pytest.mark.parametrize("name", ["op12_vector_codes", "op13_collocations"])
def test_matches_sql(spark, name):
    from gridloom.llm import queries

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    cols = sorted(df.columns)
    want = con.sql(queries.oracle_sql()[name])
    assert cols == sorted(want.columns)
    assert canonical(tuple(r) for r in df.select(cols).collect()) == canonical(want.select(*[f'"{c}"' for c in cols]).fetchall())


def test_non_negative_risk_finds_the_prior_and_the_negatives():
    rng = np.random.default_rng(4)
    good, bad = rng.normal(0, 1, (4000, 3)), rng.normal([5, 0, 0], 1, (1000, 3))
    model = quality.fit(good[:2000], np.concatenate([good[2000:], bad[:500]]))
    assert abs(model["prior"] - 0.8) < 0.05
    score = lambda x: quality.expanded(x, np.array(model["knots"])) @ np.array(model["w"]) + model["bias"]
    assert (score(bad[500:]) < 0).mean() > 0.9 and (score(good) > 0).mean() > 0.95


def test_risk_goes_up_where_it_would_be_negative():
    x = np.ones((10, 1), np.float32)
    w, _ = quality.descend(x, x[:5], 0.99, 50, 0.0)
    assert np.isfinite(w).all()


def test_quality_scores(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.quality(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    good, bad = got.score[got.quality == 1], got.score[got.quality == 0]
    assert (good.to_numpy()[:, None] > bad.to_numpy()).mean() > 0.95
    assert (good >= 0.3).mean() > 0.97 and (bad < 0.3).mean() > 0.6
    assert ((got.score >= 0.3) == (got.predicted == 1)).all() and got.prior.between(0.7, 0.97).all()


def test_quality_of_odd_rows(spark, rows):
    labels = spark.createDataFrame([(i, i % 3 % 2) for i in range(120)] + [(5, None), (None, 1), (7, 1), (7, 0), (999, 1)], "doc_id long, quality int")
    docs = docs_of(spark, [*rows, (400, "​� ½ \U0001f600" * 3, None)])
    got = quality.quality(docs, labels).collect()
    assert Counter(r["doc_id"] for r in got) == Counter([d for d, *_ in rows] + [400])
    assert all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and __import__("zlib").crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    by_id = {r["doc_id"]: r["score"] for r in got}
    assert by_id[200] == by_id[201]  # a null text is an empty one
    again = quality.quality(docs.repartition(7), labels.repartition(3)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    none = quality.quality(docs, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    assert quality.quality(docs.limit(0), labels).count() == 0
