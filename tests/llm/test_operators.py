"""Each corpus operator against brute force, over a table with every kind of difficult row."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from gridloom.llm import exact_dedup, fingerprints, minhash, mixing, packing, sharding, substring_dedup, suffix_dedup, tokens, toxicity
from tests.llm import brute

SF = "/root/testdata/sf0.001"
#: Names that clash with columns that operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, size string, key string, th string, row string, bucket string, uid string, run string, cid string"


def table(spark, rows):
    return spark.createDataFrame([(d, t, "en", s, len(t or ""), *["x"] * 9) for d, t, s in rows], SCHEMA)


def word(rng):
    return "".join(rng.choice("abcdeéß") for _ in range(rng.randint(2, 7)))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    texts = [" ".join(word(rng) for _ in range(rng.choice([3, 40, 150, 400]))) for _ in range(30)]
    passage = " ".join(word(rng) for _ in range(90))
    long = "\n".join(" ".join(word(rng) for _ in range(30)) + "." for _ in range(150))
    out = [(i, t, f"s{i % 3}") for i, t in enumerate(texts)]
    out += [(100 + i, f"{texts[i]} {passage} {texts[-i - 1]}", "hot") for i in range(12)]
    out += [(200 + i, texts[4], "hot") for i in range(25)]
    near = texts[6].split()
    for i in range(6):
        changed = list(near)
        changed[(i * 37) % len(changed)] = f"new{i}"
        out.append((300 + i, " ".join(changed), "s1"))
    out += [(400, None, None), (401, "", "s0"), (402, "   \n ", None), (403, "Same TEXT here", "s0"), (404, "same text here", "s1"), (404, "same text here", "s1"), (None, texts[8], "s2"), (None, None, "s2"), (405, "one", "s9"), (406, long, "hot"), (407, long[:5000] + " more", "hot"), (408, "ab " * 900, "s1"), (409, "Line\n\nline  two <|endoftext|> 日本語 Ünïcode\t½", "s1")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return table(spark, rows).repartition(4)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, *cols):
    return Counter(tuple(r) for r in df.select("doc_id", *cols).collect())


def test_exact_dedup(docs, rows, empty):
    low = lambda t: (t or "").translate(str.maketrans(exact_dedup.UPPER, exact_dedup.LOWER))
    groups = defaultdict(list)
    for d, t, _ in rows:
        groups[low(t)].append(d)
    got = exact_dedup.exact_dedup(docs).collect()
    want = Counter((d, max((x for x in groups[low(t)] if x is not None), default=None), len(groups[low(t)]), hashlib.sha256(low(t).encode()).hexdigest()) for d, t, _ in rows)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    kept = Counter(r["text_sha256"] for r in got if r["kept"])
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_sharding(docs, rows, empty):
    got = sharding.stratified_shards(docs, shards=7).collect()
    assert len(got) == len(rows)
    shards = defaultdict(list)
    for r in got:
        shards[r["shard"]].append(r["slot"])
        assert r["law"] == "rows" and r["grown_shard"] is None
    counts = [len(x) for x in shards.values()]
    assert len(shards) == 7 and max(counts) - min(counts) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in shards.values())
    want = Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, _ in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    assert sharding.stratified_shards(empty).count() == 0


def test_shards_match_the_mixture(spark):
    docs = spark.createDataFrame([(i, f"text {i}", "hot" if i % 3 else f"s{i % 4}") for i in range(800)], "doc_id long, text string, source string")
    per = Counter((r["shard"], r["source"]) for r in sharding.stratified_shards(docs, shards=10).join(docs, "doc_id").collect())
    total = Counter(s for (_, s), n in per.items() for _ in range(n))
    assert all(abs(n - total[s] / 10) <= 2 for (_, s), n in per.items())


def water_level(sizes, weights=(3, 1, 2), share=1.5, repeat=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    cap, capped, total = {s: repeat * sizes[s] for s in names}, set(), share * sum(sizes.values())
    while True:
        rest = [s for s in names if s not in capped]
        left = total - sum(cap[s] for s in capped)
        target = {s: cap[s] if s in capped else left * w[s] / sum(w[x] for x in rest) for s in names}
        over = {s for s in rest if target[s] > cap[s]}
        if not over:
            return target
        capped |= over


@pytest.mark.parametrize("block", [8, 256])
def test_mixing(docs, rows, empty, block):
    size = lambda t: len(brute.WORDS.findall(t or ""))
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    target = water_level(dict(sizes))
    tables = mixing.mix_sources(docs, block=block)
    got = tables["documents"].collect()
    assert Counter((r["id"], r["size"]) for r in got) == Counter((d, size(t)) for d, t, _ in rows)
    taken = Counter()
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(target[r["source"]])
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 0.5 + 1e-6 for s in sizes)
    again = mixing.mix_sources(docs.repartition(2), block=block)["documents"]
    assert by_id(again.withColumnRenamed("id", "doc_id"), "taken") == Counter((r["id"], r["taken"]) for r in got)
    assert tables["slots"].groupBy("src", "index").count().filter("count > 2").count() == 0
    assert mixing.mix_sources(empty)["documents"].count() == 0


def test_mixing_leaves_words_of_a_source_with_a_small_target(spark):
    docs = spark.createDataFrame([(i, "w " * 40, f"s{i % 3}") for i in range(90)], "doc_id long, text string, source string")
    got = mixing.mix_sources(docs, weights=(8, 1, 1), block=16)["documents"].groupBy("source").agg({"taken": "sum", "target": "max", "source_size": "max"}).collect()
    assert all(abs(r["sum(taken)"] - r["max(target)"]) <= 0.5 for r in got)
    docs = spark.createDataFrame([(i, "w " * 40, "a" if i < 80 else "b") for i in range(90)], "doc_id long, text string, source string")
    rows = mixing.mix_sources(docs, share=0.5, block=16)["documents"].groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    assert all(abs(r["sum(taken)"] - r["max(target)"]) <= 0.5 for r in rows)


def test_permutation_is_one(spark):
    from pyspark.sql import functions as F

    df = spark.range(137).select("id", mixing.permuted(F.col("id"), F.lit(137), [F.lit(3)]).alias("to"))
    df = df.withColumn("back", mixing.permuted(F.col("to"), F.lit(137), [F.lit(3)], inverse=True))
    got = df.collect()
    assert sorted(r["to"] for r in got) == list(range(137)) and all(r["back"] == r["id"] for r in got) and any(r["to"] != r["id"] for r in got)


def test_token_counts(docs, rows, empty):
    path = tokens.tokenizer_path("word_bpe_49k.json")
    t = tokens.load_tokenizer(path)
    want = Counter((d, len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False).ids), n > 2048) for d, x, _ in rows)
    for head in (3, 200_000):
        assert by_id(tokens.token_counts(docs, path, head=head), "n_bytes", "n_tokens", "over_limit") == want
    assert tokens.token_counts(empty, path).count() == 0


def test_fast_ids_are_the_library_s():
    e = tokens.ByteIds(tokens.tokenizer_path("byte_bpe_50k.json"))
    w = tokens.load_tokenizer(tokens.tokenizer_path("word_bpe_49k.json"))
    rng = random.Random(3)
    alphabet = "aAzZ019 '\n.,!-_§¿éÉßøɏ½²ª…“—<|>\t#st're\x1c\xa0日İ"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    for at in range(0, len(texts), 100):
        assert e.batch(texts[at : at + 100]) == [e.whole(t) for t in texts[at : at + 100]]
    for t in filter(tokens.plain, texts):
        assert sum(len(w.encode(p, add_special_tokens=False).ids) for p in tokens.word_pretokens(t)) == len(w.encode(t, add_special_tokens=False).ids)


def test_packing(docs, rows, empty):
    path = tokens.tokenizer_path("byte_bpe_50k.json")
    t = tokens.load_tokenizer(path)
    got = packing.pack(packing.token_pieces(docs, path, 512), 512).collect()
    want = Counter()
    for d, x, _ in rows:
        ids = np.asarray([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % 512 or min(512, len(ids))
        cuts = [0, *range(first, len(ids) + 1, 512)]
        want.update((d, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)))
    assert Counter((r["id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 512
    fit: list[int] = []
    for n in sorted((r["length"] for r in got), reverse=True):
        k = next((i for i, x in enumerate(fit) if x + n <= 512), None)
        if k is None:
            fit.append(n)
        else:
            fit[k] += n
    assert len(bins) <= len(fit)
    assert packing.pack(packing.token_pieces(empty, path)).count() == 0


def test_best_two_fit_replaces_the_smallest():
    # greedily 6 + 1, and 3 more stay open; 2 + 2 in place of the 1 fill the bin
    assert packing.best_two_fit({6: 1, 1: 1, 2: 2}, 10) in ([(1, [6, 2, 2]), (1, [1])], [(1, [6, 2, 1]), (1, [2])])
    for seed in range(20):
        rng = np.random.default_rng(seed)
        counts = Counter(int(x) for x in rng.integers(1, 60, 300))
        bins = packing.best_two_fit(dict(counts), 64)
        assert all(sum(b) <= 64 for _, b in bins)
        assert sum((Counter({n: b.count(n) * m for n in set(b)}) for m, b in bins), Counter()) == counts


def test_substring_dedup(docs, rows, empty):
    want = Counter((d, *x) for (d, _, _), x in zip(rows, brute.words_removed([t for _, t, _ in rows]), strict=True))
    got = substring_dedup.substring_dedup(docs)
    assert by_id(got, "n_words", "n_removed", "kept_sha256") == want
    assert sum(x[2] for x in want) > 1000
    assert substring_dedup.substring_dedup(empty).count() == 0


def test_suffix_dedup(docs, rows, empty):
    want = Counter((d, *x) for (d, _, _), x in zip(rows, brute.bytes_removed([t for _, t, _ in rows]), strict=True))
    assert by_id(suffix_dedup.suffix_dedup(docs), "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    assert suffix_dedup.suffix_dedup(empty).count() == 0


def test_paths_compact_and_rings_stay_single(spark):
    # 1-2-3-4 branches into 5 and 6; 7-8-9 is a ring, 10 a loop, 11 alone
    edges = [(1, 101, 102), (2, 102, 103), (3, 103, 104), (4, 104, 105), (5, 105, 106), (6, 105, 107), (7, 201, 202), (8, 202, 203), (9, 203, 201), (10, 300, 300), (11, 400, 401)]
    got = {r[0]: tuple(r[1:]) for r in substring_dedup.placed(spark.createDataFrame(edges, "e long, tail long, head long")).collect()}
    assert got == {1: (1, 0), 2: (1, 1), 3: (1, 2), 4: (1, 3), 5: (5, 0), 6: (6, 0), 7: (7, 0), 8: (8, 0), 9: (9, 0), 10: (10, 0), 11: (11, 0)}


def test_repeats_of_every_phase_and_period(spark):
    rng = random.Random(5)
    base = [word(rng) for _ in range(300)]
    texts = [" ".join(base), *(" ".join([word(rng), *base[i : i + 120 + 7 * i], word(rng)]) for i in range(0, 60, 9))]
    texts += [" ".join((base[:p] * 200)[:200]) for p in (1, 2, 3, 7, 36)] + [" ".join([*base[100:160], *base[90:150], *base[100:140]])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = Counter((d, *x) for d, x in enumerate(brute.words_removed(texts)))
    assert by_id(substring_dedup.substring_dedup(docs), "n_words", "n_removed", "kept_sha256") == want
    want = Counter((d, *x) for d, x in enumerate(brute.bytes_removed(texts)))
    assert by_id(suffix_dedup.suffix_dedup(docs), "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


def test_passages_of_many_words_go_only_from_400_bytes_on(spark):
    rng = random.Random(17)
    own = lambda: " ".join(f"{rng.getrandbits(48):012x}" for _ in range(60))
    texts = []
    for size in (399, 400, 401):
        passage = " ".join(f"{rng.getrandbits(20):05x}" for _ in range(70))[:size]
        assert len(passage.split()) > 50 and len(passage) == size
        texts += [f"{own()} <{passage}> {own()}", f"{own()} ({passage}) {own()}"]
    passage = "".join(chr(0xE0 + rng.randrange(16)) for _ in range(200))  # 200 characters of two bytes each
    texts += [f"{own()} <{passage}> {own()}", f"{own()} ({passage}) {own()}"]
    got = {r["doc_id"]: r for r in suffix_dedup.suffix_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [(got[i]["n_removed"], got[i]["n_spans"]) for i in range(8)] == [(0, 0)] * 2 + [(400, 1)] * 2 + [(401, 1)] * 2 + [(400, 1)] * 2
    assert [got[i]["n_bytes"] for i in range(8)] == [len(t.encode()) for t in texts]
    assert [tuple(got[i][c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) for i in range(8)] == list(brute.bytes_removed(texts))


def test_ranks_keep_the_order_of_pairs(spark):
    pairs = [(3, 1), (1, 9), (3, 1), (1, 9), (1, 2), (2, 5), (2, 5), (2, 4), (2, 4)]
    rows = spark.createDataFrame([(i, a, b, 1) for i, (a, b) in enumerate(pairs)], "uid long, a long, b long, n long")
    ranks = {pairs[r["uid"]]: r["rank"] for r in suffix_dedup.reranked(rows).collect()}
    assert set(ranks) == {p for p in pairs if pairs.count(p) > 1}
    assert sorted(ranks, key=ranks.get) == sorted(ranks)


def test_near_dedup(docs, rows, empty):
    real = [(d if d is not None else -(2**63), t) for d, t, _ in rows]
    brute_classes = brute.near_classes(real)
    classes = [None if c == -(2**63) else c for c, _ in brute_classes]
    got = minhash.near_dedup(docs).collect()
    assert Counter((r["doc_id"], r["class_id"]) for r in got) == Counter((d, c) for (d, _, _), c in zip(rows, classes, strict=True))
    size = Counter(k for _, k in brute_classes)
    assert Counter(r["class_size"] for r in got) == Counter(n for n in size.values() for _ in range(n))
    assert sum(r["kept"] for r in got) == len(size)
    assert minhash.near_dedup(empty).count() == 0


def test_alignment_is_the_longest_common_subsequence():
    rng = np.random.default_rng(5)
    for _ in range(60):
        a = rng.integers(0, 6, rng.integers(5, 60)).astype(np.uint64)
        b = np.delete(a, rng.integers(0, len(a), 3))
        b = np.insert(b, rng.integers(0, len(b), 3), rng.integers(0, 6, 3).astype(np.uint64))
        d = len(a) + len(b) - 2 * brute.lcs(a.tolist(), b.tolist())
        assert minhash.aligned(a, b, d) == d
        assert d == 0 or minhash.aligned(a, b, d - 1) is None
        m = (len(a) + len(b) - d) // 2
        assert minhash.similar(a, b) == (m / (len(a) + len(b) - m) >= 0.8)


def test_order_sketches_tell_reordered_texts():
    words = [f"w{i}" for i in range(400)]
    h = minhash.shingles(" ".join(words).encode())
    swapped = minhash.shingles(" ".join(words[200:] + words[:200]).encode())
    same = minhash.shingles(" ".join([*words[:50], "x", *words[51:]]).encode())
    agree = lambda x: int((minhash.sketch(h) == minhash.sketch(x)).sum())
    assert agree(same) > 12 and agree(swapped) < 14 and agree(swapped) < agree(same)


def test_fingerprints(docs, rows, empty):
    got = fingerprints.fingerprints(docs)
    assert got.count() == len(rows)
    one = {d: t or "" for d, t, _ in rows if d is not None and Counter(x for x, _, _ in rows)[d] == 1}
    order = sorted([(d, t or "") for d, t, _ in rows if d is not None], reverse=True)
    found = {r["doc_id"]: r for r in got.collect()}
    prints = defaultdict(set)
    for d, t in one.items():
        k = next(i for i, x in enumerate(order) if x[0] == d)
        prints[t].add(found[d]["fingerprint"])
        if k + 1 == len(order):
            continue
        q = len(t) // 3
        edited = t[: len(t) - q] + order[k + 1][1][:q]
        assert (found[d]["n_chars"], found[d]["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= found[d]["near_next"] <= 1 and (edited != t or found[d]["near_edited"] == 1)
        if len(t) > 600 and t != order[k + 1][1] and edited != t:
            assert 0.3 < found[d]["near_edited"] < 1
    assert all(len(x) == 1 for x in prints.values())
    assert fingerprints.fingerprints(empty).count() == 0


def listed(cells, at):
    """Peel a sketch (cell to count, digest sum, check sum): digests of count 1, of count -1, and whether nothing is left."""
    cells, gone, new = dict(cells), set(), set()
    while pure := [(n, d) for n, d, c in cells.values() if abs(n) == 1 and d in at and at[d][1] == c]:
        for n, d in set(pure):
            (gone if n > 0 else new).add(d)
            for p in at[d][0]:
                m, x, c = cells.get(p, (0, 0, 0))
                cells[p] = (m - n, x ^ d, c ^ at[d][1])
        cells = {p: x for p, x in cells.items() if x != (0, 0, 0)}
    return gone, new, not cells


def test_returned_fingerprints_give_the_likeness(spark, docs, rows):
    """The written text alone, read and peeled here, lists the text and gives near_edited and near_next."""
    from pyspark.sql import functions as F

    one = {d: t or "" for d, t, _ in rows if d is not None and Counter(x for x, _, _ in rows)[d] == 1}
    order = sorted([(d, t or "") for d, t, _ in rows if d is not None], reverse=True)
    after = {d: order[k + 1] for k, (d, _) in enumerate(order[:-1]) if d in one and order[k + 1][0] in one}
    texts = spark.createDataFrame([(d, t) for d, t in one.items()], "doc_id long, text string")
    digests = {r["doc_id"]: set(r["a"]) for r in texts.select("doc_id", fingerprints.digests(F.col("text")).alias("a")).collect()}
    edited = spark.createDataFrame([(d, one[d][: len(one[d]) - len(one[d]) // 3] + t[: len(one[d]) // 3]) for d, (_, t) in after.items()], "doc_id long, text string")
    changed = {r["doc_id"]: set(r["a"]) for r in edited.select("doc_id", fingerprints.digests(F.col("text")).alias("a")).collect()}
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(docs).collect()}
    signed = lambda x: x - (1 << 64) if x >> 63 else x

    def read(text):
        size, _, cells = text.partition(":")
        parts = [[int(x, 16) for x in c.split(".")] for c in cells.split("-") if c]
        return int(size or "0", 16), {p: (n, signed(d), signed(c)) for p, n, d, c in parts}

    sizes = {read(got[d][c])[0] for d in after for c in ("fingerprint", "edited_fingerprint")} | {read(got[d]["fingerprint"])[0] for d, _ in after.values()}
    known = spark.createDataFrame([(d, s) for d in set().union(*digests.values(), *changed.values()) for s in sizes - {0}], "d long, size long")
    at = defaultdict(dict)
    for r in known.select("d", "size", F.array(*fingerprints.places(F.col("d"), F.col("size"), fingerprints.SALT)).alias("p"), fingerprints.check(F.col("d")).alias("c")).collect():
        at[r["size"]][r["d"]] = (r["p"], r["c"])

    def sketch(digests, size):
        out = {}
        for d in digests:
            for p in at[size][d][0]:
                n, x, c = out.get(p, (0, 0, 0))
                out[p] = (n + 1, x ^ d, c ^ at[size][d][1])
        return out

    def difference(a, b):
        (s, x), (t, y) = read(a), read(b)
        size = max(s, t)
        if s < size:
            x = sketch(listed(x, at[s])[0], size)
        if t < size:
            y = sketch(listed(y, at[t])[0], size)
        minus = {p: (x.get(p, (0, 0, 0))[0] - y.get(p, (0, 0, 0))[0], x.get(p, (0, 0, 0))[1] ^ y.get(p, (0, 0, 0))[1], x.get(p, (0, 0, 0))[2] ^ y.get(p, (0, 0, 0))[2]) for p in x.keys() | y.keys()}
        return listed({p: v for p, v in minus.items() if v != (0, 0, 0)}, at[size])

    assert max(map(len, digests.values())) > 100
    for d, (n, _) in after.items():
        own = read(got[d]["fingerprint"])
        assert listed(own[1], at[own[0]]) == (digests[d], set(), True)
        for name, print_, other in (("edited", got[d]["edited_fingerprint"], changed[d]), ("next", got[n]["fingerprint"], digests[n])):
            gone, new, whole = difference(got[d]["fingerprint"], print_)
            assert whole and (gone, new) == (digests[d] - other, other - digests[d])
            assert (set(got[d][f"{name}_gone"]), set(got[d][f"{name}_new"])) == (gone, new)
            assert got[d][f"near_{name}"] == pytest.approx(len(digests[d] & other) / len(digests[d] | other) if digests[d] | other else 1.0)


def test_drawn_words_are_within_one_document_of_the_mix(spark):
    rng = random.Random(3)
    data = [(i, " ".join(f"w{i}" for _ in range(rng.choice([1, 3, 20, 200]) if i else 4000)), f"s{i % 3}") for i in range(400)]
    docs = table(spark, data)
    size = {d: len(t.split()) for d, t, _ in data}
    taken, longest, drawn = Counter(), Counter(), Counter()
    mix = mixing.mix_sources(docs)
    for r in mix["documents"].collect():
        taken[r["source"]] += r["taken"]
        longest[r["source"]] = max(longest[r["source"]], r["size"])
    for r in mixing.drawn(docs).select("doc_id", "source").collect():
        drawn[r["source"]] += size[r["doc_id"]]
    assert all(abs(drawn[s] - taken[s]) <= longest[s] for s in taken)
    assert sum(r["words"] for r in mix["shards"].collect()) == sum(taken.values())


def test_sketches_grow_until_all_is_recovered(spark, monkeypatch):
    """From sketches of three cells on, which hold one digest: nothing that differs is left out."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(fingerprints, "cells_of", lambda n: F.lit(3).cast("long"))
    data = [(i, list(range(i * 1000, i * 1000 + n)), list(range(i * 1000 + k, i * 1000 + n + k)), list(range(i * 1000 + 500, i * 1000 + 500 + m))) for i, (n, k, m) in enumerate([(40, 40, 40), (40, 7, 3), (1, 0, 200), (0, 0, 9), (90, 90, 90), (2, 1, 0)])]
    sets = spark.createDataFrame([(i, 0, 0, a, b, c) for i, a, b, c in data], "r long, th long, v int, own array<long>, other array<long>, next array<long>")
    got = {r["r"]: r for r in fingerprints.subtracted(sets).collect()}
    for i, a, b, c in data:
        for k, x in ((0, b), (1, c)):
            assert (sorted(got[i][f"gone{k}"]), sorted(got[i][f"new{k}"])) == (sorted(set(a) - set(x)), sorted(set(x) - set(a)))


def test_sketches_peel_what_differs(spark):
    data = [(i, list(range(i * 100, i * 100 + 40)), list(range(i * 100 + k, i * 100 + 40 + k))) for i, k in enumerate((0, 1, 7, 20, 60))]
    pairs = spark.createDataFrame([(i, 0, 0, 0, a, b) for i, a, b in data], "r long, th long, v int, kind int, a array<long>, b array<long>").repartition("r", "th")
    got = {r["r"]: r for r in fingerprints.peeled(pairs, 2.2, 24, 1).collect()}
    assert all(got[i]["whole"] and got[i]["differing"] == len(set(a) ^ set(b)) for i, a, b in data)
    small = fingerprints.peeled(pairs, 0.1, 3, 1).filter("r = 4").first()
    assert not small["whole"]


def test_toxicity_learns_and_locates(spark, docs, empty):
    rng = random.Random(11)
    bad = ["grumbly", "grumblo", "zorxish"]
    texts, labels = [], []
    for i in range(400):
        s = [" ".join(word(rng) for _ in range(6)) for _ in range(8)]
        if i % 4 == 0:
            s[i % 8] += " " + bad[i % 3]
        texts.append((i, ". ".join(s) + ".", "s"))
        labels.append((i, i % 4 == 0))
    d = table(spark, texts)
    model = toxicity.train(d, spark.createDataFrame([(i, int(y)) for i, y in labels], "doc_id long, toxic int"))
    got = {r["doc_id"]: r for r in toxicity.score(d, model).collect()}
    held = [(i, y) for i, y in labels if got[i]["held_out"]]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _ in labels)
    assert sum((got[i]["predicted"] == 1) == y for i, y in held) / len(held) > 0.97
    for i, y in held:
        if y and got[i]["predicted"]:
            assert i % 8 in [x["sentence"] for x in got[i]["offending"]]
    assert toxicity.without_toxic(d, model).columns == d.columns
    scored = toxicity.score(docs, model)
    assert scored.count() == docs.count() and scored.filter("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.score(empty, model).count() == 0
    none = toxicity.train(empty, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(docs, none).filter("predicted = 1").count() == 0


def test_pipeline(spark, docs, rows):
    import corpus_pipeline as c

    assert [n for n, _ in c.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]
    start, seen = docs, {}
    for name, f in c.STAGES:
        docs = c.staged(f(spark, docs, SF), name)
        seen[name] = docs
        if name != "packing":
            assert docs.columns == start.columns
    ids = lambda n: [r["doc_id"] for r in seen[n].select("doc_id").collect()]
    low = lambda t: (t or "").translate(str.maketrans(exact_dedup.UPPER, exact_dedup.LOWER))
    texts = [low(r["text"]) for r in seen["toxicity"].collect()]
    assert len(ids("exact_dedup")) == len(set(texts))
    left = [(r["doc_id"] if r["doc_id"] is not None else -(2**63), r["text"]) for r in seen["exact_dedup"].collect()]
    assert len(ids("near_dedup")) == len({k for _, k in brute.near_classes(left)})
    assert set(ids("mixing")) <= set(ids("near_dedup")) and max(Counter(ids("mixing")).values()) <= 2
    assert Counter(r["doc_id"] for r in seen["packing"].filter("piece = 0").collect()) == Counter(ids("mixing"))


def test_queries_run_on_whole_tables(spark):
    from gridloom.llm import queries

    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name, f in queries.queries().items():
        out = f(spark, SF)
        got = out.filter("piece = 0").count() if "piece" in out.columns else out.count()
        assert got == n, name


def test_scores_are_the_noisy_or_of_sentences(spark):
    """Every score worked out anew from the weights alone."""
    import math
    import re

    model = {"": -3.0, "bad": 2.5, "badl*": 1.0, "good": -2.0, "mean": 4.0}
    texts = ["Bad day. Good day! mean\nbadly done", "good", "", None, "bad bad bad", " . ! ", "MEAN good bad badl", "x " * 5000 + "mean."]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)] + [(None, "mean", "en"), (3, "mean", "en")], "doc_id long, text string, score string")
    got = {(r["doc_id"], r["held_out"]): r for r in toxicity.score(docs.filter("doc_id is null or text is null or text != 'mean'"), model).collect()}
    for i, t in enumerate(texts):
        none = 1.0
        for s in [s for s in re.split(r"[.!?\n]+", (t or "").lower()) if s.strip()] or [""]:
            z = model[""]
            for w in set(re.findall(r"[^\W\d_]+", s)):
                z += model.get(w, 0) + sum(model.get(w[:k] + "*", 0) for k in (4, 5, 6) if len(w) >= k)
            none *= 1 - 1 / (1 + math.exp(-z))
        row = next(r for (d, _), r in got.items() if d == i)
        assert row["score"] == pytest.approx(1 - none) and row["predicted"] == int(1 - none >= 0.5)
        assert row["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
    assert not next(r for (d, _), r in got.items() if d is None)["held_out"]
    assert toxicity.score(docs, model).filter("doc_id = 3").count() == 2


def test_noisy_or_gradient_separates():
    """The fit on sparse arrays: a document is toxic by one sentence alone."""
    rng = np.random.default_rng(2)
    ids, sizes, owner, y = [], [], [], []
    for d in range(300):
        y.append(d % 3 == 0)
        for k in range(4):
            words = rng.choice(np.arange(1, 40), 5, replace=False).tolist() + [0] * (d % 3 == 0 and k == d % 4)
            ids += words
            sizes.append(len(words))
            owner.append(d)
    w, bias = toxicity.fit_noisy_or(np.array(ids, np.int32), np.array(sizes, np.int32), np.array(owner), np.zeros(300), np.array(y), np.ones(300), 40)
    assert bias < -2 and w[0] > 3 and w[0] > 3 * np.abs(w[1:]).max()
    assert np.isfinite(toxicity.fit_noisy_or(np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, int), np.ones(2), np.array([0, 1]), np.ones(2), 3)[1])


def test_equal_texts_share_a_shard(spark):
    rng = random.Random(5)
    data = [(i, f"text {i}", f"s{i % 4}") for i in range(600)]
    data += [(1000 + 10 * g + j, f"copy {g}", f"s{rng.randint(0, 4)}" if j else None) for g in range(60) for j in range(rng.randint(2, 5))]
    data += [(5000 + i, "hot", "s1") for i in range(400)] + [(7, "text 7", "s3")] * 3
    got = sharding.stratified_shards(table(spark, data), shards=12).join(spark.createDataFrame(sorted({(d, t) for d, t, _ in data}), "doc_id long, text string"), "doc_id").collect()
    where, slots = defaultdict(set), defaultdict(list)
    for r in got:
        where[r["text"]].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
    assert all(len(s) == 1 for t, s in where.items() if t != "hot") and len(where["hot"]) > 1
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and len(slots) == 12
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_exact_dedup_can_retain_the_smallest(spark):
    got = exact_dedup.exact_dedup(table(spark, [(3, "A", "s"), (2, "a", "s"), (None, "a", "s"), (9, "b", "s")]), retain="smallest").collect()
    assert {(r["doc_id"], r["keep_id"], r["kept"]) for r in got} == {(3, 2, False), (2, 2, True), (None, 2, False), (9, 9, True)}


@pytest.mark.parametrize("runs,parts", [(1, 1), (2, 3), (5, 2), (16, 7)])
def test_exact_dedup_gives_the_same_for_any_runs_and_ranges(spark, runs, parts):
    long = "Ab " * 400_000
    rows = [(7, "x", "s")] * 40 + [(i, "X", "s") for i in range(20)] + [(None, "x", "s"), (None, None, "s"), (None, "", "s"), (3, long, "s"), (4, long.lower(), "s"), (5, long + "c", "s")]
    got = exact_dedup.exact_dedup(table(spark, rows).repartition(3), runs=runs, parts=parts).collect()
    low = lambda t: (t or "").translate(str.maketrans(exact_dedup.UPPER, exact_dedup.LOWER))
    groups = defaultdict(list)
    for d, t, _ in rows:
        groups[low(t)].append(d)
    want = Counter((d, max((x for x in groups[low(t)] if x is not None), default=None), len(groups[low(t)]), hashlib.sha256(low(t).encode()).hexdigest()) for d, t, _ in rows)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len(groups) == len({r["text_sha256"] for r in kept}) and all(r["doc_id"] == r["keep_id"] for r in kept)


def test_words_on_which_polynomials_agree_differ():
    bits = [0]
    while len(bits) < 1024:
        bits += [1 - b for b in bits]
    a, b = ("".join(x[k] for k in bits).encode() for x in ("ab", "ba"))
    assert minhash.shingles(a) != minhash.shingles(b)
    x = np.array(bits, np.uint64)
    assert minhash.aligned(x, np.uint64(1) - x, 1) is None


def test_wide_bands_are_aligned_by_matches(monkeypatch):
    monkeypatch.setattr(minhash, "WIDE", 0)
    test_alignment_is_the_longest_common_subsequence()


def test_slots_follow_the_drawn_counts(docs):
    tables = mixing.mix_sources(docs, block=8, shards=5)
    slots = tables["slots"].collect()
    by = defaultdict(list)
    for r in sorted(slots, key=lambda r: (r["src"], r["slot"])):
        by[r["src"]].append(r["shard"])
    assert all(x == sorted(x) for x in by.values()) and max(len(set(x)) for x in by.values()) == 5
    for r in tables["documents"].collect():
        assert bool(r["shards"]) == (r["taken"] > 0) and set(r["shards"]) <= set(range(5))


def test_fingerprints_of_hot_ids_and_far_off_ones(spark):
    """Null ids, an id with most rows, a row repeated often, and the two ends of long: order and likeness against brute force."""
    data = [(i, f"line {i}\n" * (i % 5) + "common\n" * 3) for i in range(700)]
    data += [(None, f"null {i}\nx") for i in range(900)] + [(50, f"hot {i}\ny") for i in range(800)] + [(60, "same\nsame again")] * 900
    data += [(2**63 - 1, "last"), (-(2**63) + 1, "first\nof all")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = fingerprints.fingerprints(docs).collect()
    assert Counter((r["doc_id"], r["n_chars"]) for r in got) == Counter((d, len(t)) for d, t in data)
    assert all(r["near_edited"] is not None and 0 <= r["near_next"] <= 1 for r in got)
    same = [r["near_next"] for r in got if r["doc_id"] == 60 and r["n_chars"] == 15]
    assert sorted(same)[1:] == [1.0] * 899
    single = {d: t for d, t in data if d is not None and d not in (50, 60)}
    order = sorted(single, reverse=True)
    found = {r["doc_id"]: r for r in got if r["doc_id"] in single}
    for d, n in zip(order, order[1:], strict=False):
        if {d, n} & {49, 51, 59, 61} or d == order[-1]:
            continue
        q = len(single[d]) // 3
        assert found[d]["edited_sha256"] == hashlib.sha256((single[d][: len(single[d]) - q] + single[n][:q]).encode()).hexdigest(), d
    # the last in order are the null ids, and after them comes the first document again
    starts = {hashlib.sha256((t[: len(t) - len(t) // 3] + "last"[: len(t) // 3]).encode()).hexdigest() for d, t in data if d is None}
    assert sum(r["edited_sha256"] in starts for r in got if r["doc_id"] is None) >= 1


def test_pipeline_stages_take_an_empty_table_and_null_labels(spark, tmp_path):
    import corpus_pipeline as c

    spark.createDataFrame([(1, None), (2, 1), (None, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    empty = spark.createDataFrame([], SCHEMA)
    for name, stage in c.STAGES:
        got = stage(spark, empty, str(tmp_path))
        assert got.count() == 0 and (name == "packing" or got.columns == empty.columns), name
