"""Vector codes, centroid clustering and SimHash against brute force: odd rows, ties, hot buckets, and that the named methods do the pruning."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from shelfcast.llm import centroids, codes, queries, simhash, vectors
from shelfcast.llm.components import components

SCHEMA = "vec_id long, embedding array<float>, label int, kept string, v int, codes double, h string, cluster string, distance long, __label int"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(5)
    center = [[rng.gauss(0, 0.1) for _ in range(64)] for _ in range(9)]
    near = lambda: [x + rng.gauss(0, 0.03) for x in rng.choice(center)]
    rows = [(i, near(), rng.choice([0, 1, 1, 1, None])) for i in range(700)]
    rows += [(700 + i, rows[3][1], 1) for i in range(150)] + [(5, near(), 2), (5, near(), None), (None, near(), 0), (None, near(), None)]
    rows += [(900, None, 1), (901, [], 1), (902, [0.1] * 63 + [None], 1), (903, [0.1] * 63 + [float("nan")], 1), (904, [0.1] * 63 + [float("-inf")], None), (905, [0.1] * 63, 0), (906, [0.5] * 60, 1), (-1, [0.25] * 65, 1), (907, [1e30] * 64, 0)]
    path = str(tmp_path_factory.mktemp("vectors"))
    table = spark.createDataFrame([(*r, "x", 1, 0.5, "h", "c", 9, 3) for r in rows], SCHEMA).repartition(5)
    table.write.parquet(f"{path}/embeddings.parquet")
    table.limit(0).write.parquet(f"{path}/none/embeddings.parquet")
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]
    whole = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    return path, whole


def lloyd(points, start, rounds):
    """Codes, distances and entries by comparing everything."""
    book = [list(b) for b in start]
    for n in range(rounds + 1):
        found = [min((sum((a - b) ** 2 for a, b in zip(p, e)), k) for k, e in enumerate(book)) for p in points]
        if n < rounds:
            of = defaultdict(list)
            for p, (_, k) in zip(points, found):
                of[k].append(p)
            for k, ps in of.items():
                book[k] = [sum(c) // len(ps) for c in zip(*ps)]
    return [k for _, k in found], [d for d, _ in found], book


def test_op11(spark, folder):
    path, whole = folder
    rows = queries.QUERIES["op11_vector_codes"](spark, path).collect()
    ints = lambda v: [math.floor(1024 * x) for x in v]
    usual = [(i, ints(v), label) for i, v, label in whole if len(v) == 64 and max(map(abs, v)) < 1e9]
    order = sorted(usual, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    text, error, books = [""] * len(usual), [0] * len(usual), []
    for p in range(4):
        cut = lambda v, p=p: v[16 * p : 16 * p + 16]
        code, d, book = lloyd([cut(r[1]) for r in usual], [cut(r[1]) for r in order[:256]], 4)
        text, error = [t + f"{k:02x}" for t, k in zip(text, code)], [e + x for e, x in zip(error, d)]
        books += [x for e in book for x in e]
    by_label = defaultdict(int)
    for (_, _, label), e in zip(usual, error):
        by_label[label] += e
    digest = hashlib.sha256(",".join(map(str, books)).encode()).hexdigest()
    want = Counter((r[0], t, e, by_label[r[2]], digest) for r, t, e in zip(usual, text, error))
    want.update((r[0], None, None, by_label.get(r[2]), digest) for r in whole if len(r[1]) != 64 or max(map(abs, r[1])) > 1e9)
    assert Counter((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in rows) == want
    assert queries.QUERIES["op11_vector_codes"](spark, f"{path}/none").count() == 0


def test_few_vectors_and_decoding(spark):
    rows = spark.createDataFrame([(i, [float(i), 2.0, -1.5, 0.25], "a") for i in range(6)], "vec_id long, embedding array<double>, label string")
    found, books = codes.compress(rows, keep=("vec_id", "embedding"), parts=2, entries=4, rounds=2, scale=10)
    assert [b.shape for b in books] == [(4, 2)] * 2
    back = found.select("kept.*", "codes", "error", codes.decoded(F.col("codes"), books, 10).alias("near")).collect()
    for r in back:
        ints = [math.floor(10 * x) for x in r["embedding"]]
        assert sum((a - math.floor(10 * b)) ** 2 for a, b in zip(ints, r["near"])) == r["error"]
    nulls = spark.createDataFrame([(None,), ([0, 1],)], "codes array<int>").select(codes.decoded(F.col("codes"), books, 10).alias("x")).collect()
    assert nulls[0]["x"] is None and len(nulls[1]["x"]) == 4


def test_balls_equal_full_search_with_ties_and_do_less():
    rng = np.random.default_rng(3)
    points = np.concatenate([rng.integers(-3, 4, (900, 3)) + c for c in rng.integers(-60, 60, (40, 3))])
    book, code, saved = points[rng.permutation(len(points))[:60]].copy(), None, []
    book[7], book[11] = book[3], book[4]
    for n in range(8):
        if code is None:
            code, d = codes.nearest(points, book)
        else:
            code, d, work = codes.reassign(points, code, d, balls)  # noqa: F821
            saved.append(work / (len(points) * len(book)))
        full, least = codes.nearest(points, book)
        assert (code == full).all() and (d == least).all()
        before, seen = book, vectors.Sums(0, *book.shape)
        seen.add(code, points, d)
        book = book.copy()
        for k in np.flatnonzero(seen.n):
            book[k] = seen.sums[k] // seen.n[k]
            assert seen.n[k] == (code == k).sum() and seen.farthest[k] == d[code == k].max()
        balls = codes.make_balls(book, before, seen.farthest)
    assert max(saved) < 0.3 and saved[-1] < 0.05, saved
    still = codes.make_balls(book, book, seen.farthest)
    assert codes.reassign(points, *codes.nearest(points, book), still)[2] == 0


def test_distances_are_exact_for_large_components():
    a = np.array([[2**27, -(2**27), 3], [1, 2, 3]])
    b = np.array([[-(2**27), 2**27, 0]])
    assert vectors.squared(a, b).ravel().tolist() == [sum((x - y) ** 2 for x, y in zip(r, b[0].tolist())) for r in a.tolist()]


def test_op13(spark, folder):
    path, whole = folder
    rows = queries.QUERIES["op13_centroid_clustering"](spark, path).collect()
    usual = [(i, [math.floor(64 * x) for x in v]) for i, v, _ in whole if len(v) == 64 and max(map(abs, v)) < 1e9]
    key = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    code, d, book = lloyd([v for _, v in usual], [v for _, v in sorted(usual, key=key)[:16]], 3)
    per = Counter()
    for k, x in zip(code, d):
        per[k] += x
    digest = [hashlib.sha256(",".join(map(str, b)).encode()).hexdigest() for b in book]
    want = Counter((i, k, x, per[k], sum(d), digest[k]) for (i, _), k, x in zip(usual, code, d))
    want.update({(907, None, None, None, sum(d), None): 1})
    assert Counter((r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in rows) == want
    assert queries.QUERIES["op13_centroid_clustering"](spark, f"{path}/none").count() == 0


def test_simplex_bounds_hold_and_prune():
    rng = np.random.default_rng(8)
    center = rng.integers(-300, 300, (16, 64))
    points = center[rng.integers(0, 16, 4000)] + rng.integers(-30, 30, (4000, 64))
    start = np.concatenate([points[:13], points[:3]])  # repeated centroids: ties go to the smaller number
    simplex = centroids.Simplex.over(start, 12)
    assert len(simplex.pivots) == 12 and (np.abs(np.diag(simplex.corners)) > 0).all()
    between = vectors.squared(points, simplex.pivots)
    a, b = simplex.apexes(between), simplex.apexes(vectors.squared(start, simplex.pivots))
    true = np.sqrt(vectors.squared(points, start))
    flat = np.sqrt(((a[:, None, :] - b[None]) ** 2).sum(2))
    b[:, -1] *= -1
    assert (flat <= true + 1e-6).all() and (true <= np.sqrt(((a[:, None, :] - b[None]) ** 2).sum(2)) + 1e-6).all()
    code, d, work = centroids.nearest(points, between, simplex, start)
    full = vectors.squared(points, start)
    assert (code == full.argmin(1)).all() and (d == full.min(1)).all() and work < 0.35 * full.size, work / full.size


@pytest.mark.parametrize("points", [[[4, 4]], [[4, 4], [4, 4]], [[0, 0], [1, 1], [2, 2], [3, 3]]])
def test_flat_simplexes(points):
    points = np.array(points)
    simplex = centroids.Simplex.over(points)
    code, d, _ = centroids.nearest(points, vectors.squared(points, simplex.pivots), simplex, points)
    assert d.tolist() == [0] * len(points) and code.tolist() == vectors.squared(points, points).argmin(1).tolist()


def fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(fps):
    """The least number of each fingerprint's component."""
    label = list(range(len(fps)))
    for i, a in enumerate(fps):
        for j in range(i):
            if label[i] != label[j] and (a ^ fps[j]).bit_count() <= 2:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


def test_op12(spark, tmp_path):
    rng = random.Random(2)
    words = [f"w{i}é" for i in range(99)]
    texts = [None, "", " \n\t ", "one", "One", "two words", "a\x0bb\x0cc d", "x " * 90_000, "long " * 30_000 + "end"]
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([3, 8, 80, 400]))]
        texts += [" ".join(base), "\n".join(base).upper(), " ".join(base[:-1]), " ".join([*base, "more"]), " ".join(base[:5] + ["other"] + base[5:])]
    rows = [(1000 - i, t, "x", 1) for i, t in enumerate(texts)] + [(None, texts[10], "x", 1), (None, "alone without an id", "x", 1), (7, texts[12], "x", 1), (7, "of its own, id twice", "x", 1), (7, "of its own, id twice", "x", 1)]
    table = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id int")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    table.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    fps = [fingerprint(r[1]) for r in rows]
    label, least = brute(fps), {}
    for r, k in zip(rows, label):
        least[k] = min((x for x in (least.get(k), r[0]) if x is not None), default=None)
    want = Counter((r[0], f"{f:016x}", least[k]) for r, f, k in zip(rows, fps, label))
    got = queries.QUERIES["op12_simhash"](spark, str(tmp_path))
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got.collect()) == want
    assert queries.QUERIES["op12_simhash"](spark, f"{tmp_path}/none").count() == 0


@pytest.mark.parametrize("hot_from", [1, 4, 64])
def test_links_give_the_components_of_all_pairs(spark, hot_from):
    rng = random.Random(hot_from)
    fps = {0, 1 << 63, 2**64 - 1, 2**64 - 4}
    for _ in range(60):
        x = rng.getrandbits(64)
        for _ in range(rng.choice([1, 3, 6])):
            fps.add(x)
            for _ in range(rng.choice([1, 2, 2, 3])):
                x ^= 1 << rng.randrange(64)
    for fixed, free in ((0, 32), (32, 0)):  # buckets of one upper or lower segment, and its neighbours
        x = rng.getrandbits(64)
        for _ in range(120):
            y = x
            for _ in range(rng.choice([1, 2, 3])):
                y ^= 1 << (free + rng.randrange(32))
            fps |= {y, y ^ (1 << (fixed + rng.randrange(32)))}
    fps = sorted(fps)
    table = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long").repartition(4)
    pairs = simhash.links(table, hot_from)
    assert all(((r["u"] ^ r["v"]) & (2**64 - 1)).bit_count() in (1, 2) for r in pairs.collect())
    label = {r["node"] & (2**64 - 1): r["label"] for r in components(pairs).collect()}
    of = defaultdict(set)
    for f, k in zip(fps, brute(fps)):
        of[k].add(label.get(f, ("alone", f)))
    assert all(len(x) == 1 for x in of.values()) and len({next(iter(x)) for x in of.values()}) == len(of)


def test_a_large_bucket_makes_no_pairs(spark):
    """20,000 fingerprints of one lower segment: as pairs, 200 million."""
    rng = random.Random(0)
    fps = {rng.getrandbits(12) << 32 | rng.getrandbits(3) << 60 | 77 for _ in range(60_000)}
    table = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    assert simhash.links(table).count() < 80 * len(fps)
