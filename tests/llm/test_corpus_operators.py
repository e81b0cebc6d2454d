"""Jaccard join, sharding, mixing, line dedup and the pipeline against brute force, with the odd cases."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from shelfcast.llm import components, jaccard, lines, mixing, sharding

ODD = [None, "", " \t\n", "one two", "one  TWO", "a b c d e f", "long " * 4000]


def docs(spark, texts, sources=None):
    rows = [(i, t, sources[i] if sources else "s", "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, sig string")


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(texts):
    sets = [shingles(t) for t in texts]
    label = list(range(len(texts)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            n = len(a & sets[j])
            if n and 100 * n >= 80 * len(a | sets[j]) and top(i) != top(j):
                a_, b_ = sorted((top(i), top(j)))
                label[b_] = a_
    return {i: (len(s), top(i)) for i, s in enumerate(sets)}


def families(rng, sizes, copies, edits):
    """Texts and copies with edits: words changed, put in, taken out, cut off."""
    out = []
    for n in sizes:
        base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randrange(edits + 1)):
                i = rng.randrange(len(w))
                how = rng.randrange(4)
                if how == 0:
                    w[i] = f"x{rng.randrange(10**6)}"
                elif how == 1:
                    w.insert(i, f"x{rng.randrange(10**6)}")
                elif how == 2 and len(w) > 2:
                    del w[i]
                elif how == 3:
                    w = w[: max(2, len(w) - rng.randrange(1 + len(w) // 8))]
            out.append(" ".join(w))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = ODD + families(rng, [5, 7, 9, 11, 12, 13, 16, 30, 60, 100, 130, 131, 140, 165, 250, 262, 330], 9, 6) + families(rng, [150], 60, 8)
    texts += [passage + " " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 90))) for _ in range(40)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(docs(spark, texts)).collect()}
    assert got == brute(texts)


def test_jaccard_edges(spark):
    same = spark.createDataFrame([(7, "a b c d e f g"), (7, "a b c d e f g"), (3, "a b c d e f g"), (None, "a b c d e f g"), (None, None), (9, None)], "doc_id long, text string")
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(same).collect())
    assert got == Counter({(7, 3, 3): 2, (3, 3, 3): 1, (None, 3, 3): 1, (None, 0, None): 1, (9, 0, 9): 1})
    split = spark.createDataFrame([(7, "a b c d e f g"), (7, "h i j k l m n"), (8, "h i j k l m n"), (None, "o p q r s t u"), (6, "A b c d e f g")], "doc_id long, text string")
    assert Counter((r["doc_id"], r["component_id"]) for r in jaccard.near_duplicates(split).collect()) == Counter([(7, 6), (6, 6), (7, 7), (8, 7), (None, None)])
    assert jaccard.near_duplicates(same.limit(0)).count() == 0


def test_signatures_meet_the_pigeonhole():
    import numpy as np

    rng = np.random.default_rng(1)
    for size in (1, 5, 7, 8, 9, 40, 127, 128, 158, 159, 255, 256, 300, 2000):
        a = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
        for _ in range(20):
            drop = rng.permutation(len(a))[rng.integers(0, len(a) // 9 + 1) :]
            b = np.unique(np.concatenate([a[drop], rng.integers(0, 2**63, int(rng.integers(0, len(a) // 9 + 1)), dtype=np.uint64)]))
            common = len(np.intersect1d(a, b))
            if len(b) and 9 * common >= 4 * (len(a) + len(b)):
                for fine in (frozenset(), frozenset([2]), frozenset([1, 3, 6])):
                    pa, pb = (np.concatenate(jaccard.sketch(x, fine)[1:3]) for x in (a, b))
                    assert len(np.intersect1d(pa, pb)) >= 1


def test_a_poor_set_changes_its_own_band_only():
    import numpy as np

    poor = np.arange(1, 201, dtype=np.uint64)  # 200 shingles in one segment
    other = np.sort(np.random.default_rng(1).integers(0, 2**63, 300, dtype=np.uint64) * np.uint64(2))
    _, own, _, bands = jaccard.sketch(poor)
    assert len(own) == 1 and bands == [2]
    _, own, _, bands = jaccard.sketch(poor, frozenset([2]))
    assert len(own) == 200 and bands == []
    _, plain, _, bands = jaccard.sketch(other)
    assert bands == [] and jaccard.sketch(other, frozenset([2]))[1].tolist() == plain.tolist()


def test_fine_bands_give_the_same_components(spark, monkeypatch):
    """As if a set of the second band were poor: the second pass signs that band by single shingles."""
    real, asked = jaccard._class_column, []

    def claimed(text, fine):
        asked.append(fine)
        return real(text, fine).withField("poor", F.array() if fine else F.array(F.lit(2)))

    monkeypatch.setattr(jaccard, "_class_column", claimed)
    rng = random.Random(8)
    words = [f"w{i}" for i in range(3_000)]
    texts = []
    for _ in range(6):
        base = [rng.choice(words) for _ in range(rng.choice([60, 140, 160, 250, 320]))]
        for _ in range(5):
            changed = list(base)
            for _ in range(rng.randrange(1, 7)):
                changed[rng.randrange(len(base))] = "new" + str(rng.randrange(10**6))
            texts.append(" ".join(changed))
    sets = [set(zip(*[t.split()[i:] for i in range(5)], strict=False)) for t in texts]
    label = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            label[i] = min(label[j] for j, b in enumerate(sets) if i == j or 100 * len(a & b) >= 80 * len(a | b))
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(docs(spark, texts)).collect()}
    assert got == dict(enumerate(label)) and len(set(label)) < len(texts) and asked == [frozenset(), frozenset([2])]


def test_connected_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (102, 101), (5, 5)]
    got = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(31)} | {100: 100, 101: 100, 102: 100}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def largest_plan(spark, work):
    """What work returns, and the most nodes that a plan run by it has; the driver keeps the plans of its last 1,000 executions, each as often as it changed."""

    def ended():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        return spark._jsparkSession.sharedState().statusStore()

    ids = lambda: {x.apply(i).executionId() for x in [ended().executionsList()] for i in range(x.size())}
    before, out = ids(), work()
    return out, max(ended().planGraph(i).allNodes().size() for i in ids() - before)


def test_plans_of_stars_and_of_the_jaccard_join_stay_small(spark):
    chain, hub = [(i, i + 1) for i in range(20)], [(1000, 1001 + i) for i in range(1500)]
    found, nodes = largest_plan(spark, lambda: components.components(spark.createDataFrame(chain + hub, "u long, v long")).collect())
    assert {r["node"]: r["label"] for r in found} == dict.fromkeys(range(21), 0) | dict.fromkeys(range(1000, 2501), 1000)
    assert nodes <= 80
    texts = families(random.Random(11), [6, 20, 90, 200], 6, 3) + ODD
    found, nodes = largest_plan(spark, lambda: jaccard.near_duplicates(docs(spark, texts)).collect())
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute(texts)
    assert nodes <= 150


def test_sharding(spark):
    table = docs(spark, [*ODD, *["same text"] * 500]).union(docs(spark, ["again"]).crossJoin(spark.range(50)).drop("id"))
    got = sharding.shard_documents(table).collect()
    assert len(got) == table.count()
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 40) and 0 <= r["shard"] < 40
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    one = next(r for r in got if r["doc_id"] == 500)
    assert one["size"] == 9 + 16 and one["text_crc32"] == zlib.crc32(b"same text")
    assert sharding.shard_documents(table.limit(0)).count() == 0


def test_weights_move_keys_only_into_a_heavier_subtree(spark):
    keys = spark.range(4000).withColumnRenamed("id", "doc_id")
    rows = sharding.assign_shard(sharding.assign_shard(keys, sharding.balanced_tree(16), "a"), sharding.balanced_tree(16, {3: 4.0}), "b").collect()
    moved = [r for r in rows if r["a"] != r["b"]]
    assert moved and all(r["b"] // 8 == 0 and (r["b"] == 3 or r["a"] // 8 != 0 or r["a"] // 4 != r["b"] // 4) for r in moved)
    share = Counter(r["b"] for r in rows)
    assert abs(share[3] / 4000 - 4 / 19) < 0.04


def water(sizes):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight, target, free, left = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, {}, set(order), float(sum(sizes.values()))
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in free}
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_mixing(spark):
    rng = random.Random(6)
    sources = [rng.choice(["a", "b", "b", "b", "c", "é", None]) for _ in range(600)]
    texts = [None if i % 97 == 0 else " ".join("w" for _ in range(rng.randrange(0, 60))) for i in range(600)]
    rows = mixing.mix_documents(docs(spark, texts, sources)).collect()
    sizes = defaultdict(int)
    for t, s in zip(texts, sources, strict=True):
        sizes[s] += len((t or "").split())
    want, taken = water(sizes), defaultdict(int)
    assert len(rows) == 600
    for r in rows:
        s = sources[r["doc_id"]]
        assert r["size"] == len((texts[r["doc_id"]] or "").split()) and r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s])
        assert r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        taken[s] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= max(60, 0.02 * want[s]) for s in want)
    again = mixing.mix_documents(docs(spark, texts, sources).repartition(7)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))
    assert mixing.mix_documents(docs(spark, texts, sources).limit(0)).count() == 0
    assert [r["taken"] for r in mixing.mix_documents(docs(spark, [None, ""], ["x", None])).collect()] == [0, 0]


def test_mixing_includes_documents_with_their_probabilities(spark):
    sizes = [700, 90, 60, 60, *[40] * 6, *[25] * 10, *[10] * 20, *[5] * 10, 3, 3, 2, 2, 1, 1]
    n = 360
    rows = [(s * 100 + i, " ".join("w" for _ in range(size)), f"s{s:03d}") for s in range(n) for i, size in enumerate(sizes)]
    got = mixing.mix_documents(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    by_class = defaultdict(list)
    for r in got:
        by_class[round(r["target"] / r["source_size"], 6)].append(r)
    assert len(by_class) == 3
    for share, of in by_class.items():
        copies, total = int(share), sum(sizes)
        rest = share * total - copies * total
        if rest < 1:
            continue
        chance, sure = {}, set()
        while True:
            slope = (rest - sum(s for s in sizes if s in sure)) / sum(s * s for s in sizes if s not in sure and s <= rest)
            more = {s for s in sizes if s not in sure and s <= rest and slope * s >= 1}
            if not more:
                break
            sure |= more
        seen = Counter((r["size"], (r["taken"] // r["size"]) - copies) for r in of)
        for size in {s for s in sizes if sizes.count(s) > 5 or s > 50}:  # the last, best fitting one is often a very short one
            chance = 1.0 if size in sure else slope * size if size <= rest else 0.0
            times = seen[size, 0] + seen[size, 1]
            assert abs(seen[size, 1] / times - chance) < 0.12, (share, size, seen[size, 1] / times, chance)
        words = sum(r["taken"] for r in of)
        assert abs(words / sum(r["target"] for r in of[:: len(sizes)]) - 1) < 0.03


def test_a_cut_is_found_whatever_the_digits(spark):
    rng = random.Random(3)
    rows = [(s, rng.choice([0, 5, 2**51, rng.randrange(2**52)]), rng.randrange(4), i, rng.randrange(1, 9)) for s in ("a", "b", None) for i in range(1500)]
    table = spark.createDataFrame(rows, "source string, rank long, h long, row long, size long")
    limits = spark.createDataFrame([("a", 3000.5), ("b", 1e9), (None, 10.0)], "of string, rest double")
    got = {r["of"]: tuple(r["cut"]) for r in mixing.first_beyond(table, limits, 3).collect()}
    for source, rest in (("a", 3000.5), ("b", 1e9), (None, 10.0)):
        words, want = 0, None
        for r in sorted(x[1:] for x in rows if x[0] == source):
            words += r[3]
            if words > rest:
                want = r[:3]
                break
        assert got.get(source) == want


def test_many_short_texts_of_one_template(spark):
    rng = random.Random(5)
    base = [f"t{i}" for i in range(12)]
    texts = []
    for i in range(20_000):
        w = list(base)
        w[rng.randrange(12)] = f"x{i}"
        texts.append(" ".join(w))
    texts += [" ".join([*base[:11], "end", f"y{i}"]) for i in range(300)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(table).collect()}
    sets = [shingles(t) for t in texts]
    # Sets of 8 or 9 shingles link only if they differ in 1 or 2, so they share all but one or two; each pair that does has the same words at one end.
    label = list(range(len(texts)))

    def top(i):
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    by_most = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            by_most[s - {x}].append(i)
        by_most[s].append(i)
    for of in by_most.values():
        for j in of[1:]:
            if 100 * len(sets[of[0]] & sets[j]) >= 80 * len(sets[of[0]] | sets[j]):
                a, b = sorted((top(of[0]), top(j)))
                label[b] = a
    assert got == {i: top(i) for i in range(len(texts))}


def test_line_dedup(spark):
    rng = random.Random(8)
    line = lambda: " ".join(f"t{rng.randrange(10**5)}" for _ in range(6))
    passage = [line() for _ in range(12)]
    texts = ["\n".join([line() for _ in range(rng.randrange(1, 9))] + passage + [line() for _ in range(rng.randrange(1, 9))]) for _ in range(30)]
    texts += ["\n".join(line() for _ in range(10)) for _ in range(20)] + [None, "", "\n\n", "single", "single"]
    got = {r["doc_id"]: r for r in lines.dedup_lines(docs(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        if i >= 30 or i == 0:
            assert got[i]["kept"] == t and got[i]["removed_chunks"] == 0
        else:
            assert got[i]["removed_lines"] >= 2 and set(got[i]["kept"].split("\n")) <= set(t.split("\n")) and all(x in got[i]["kept"] for x in t.split("\n") if x not in passage)
            assert got[i]["kept"].count("\n") == t.count("\n") - got[i]["removed_lines"]
    seen = Counter()
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        seen.update({raw[a:b].rstrip(b"\n") for a, b, n in lines.chunks(raw) if n > 1})
    removed = sum(r["removed_chunks"] for r in got.values())
    assert removed == sum(n - 1 for n in seen.values() if n > 1)
    assert lines.dedup_lines(docs(spark, texts).limit(0)).count() == 0


def without_pairs(texts):
    """Kept text and removed lines of each of texts, in order: both lines of every adjacent pair that occurred before are removed."""
    seen, out = set(), []
    for t in texts:
        own = (t or "").split("\n")
        if own[-1] == "":
            own.pop()
        drop = set()
        for i, pair in enumerate(zip(own, own[1:])):
            drop |= {i, i + 1} if pair in seen else set()
            seen.add(pair)
        kept = "".join(x for i, x in enumerate((t or "").splitlines(keepends=True)) if i not in drop)
        out.append((None if t is None else kept, len(drop)))
    return out


def test_short_passages_equal_brute_force(spark):
    rng = random.Random(10)
    line = lambda: " ".join(f"t{rng.randrange(10**5)}" for _ in range(6))
    some = lambda n: [line() for _ in range(n)]
    passages = [some(2 + i % 4) for i in range(40)]
    texts = ["\n".join([*some(rng.randrange(4)), *p, *some(rng.randrange(4)), *rng.choice(passages)]) + rng.choice(["", "\n"]) for p in passages for _ in range(3)]
    alone = line()
    texts += ["\n".join([*some(2), alone, *some(2)]) for _ in range(5)] + [None, "", "\n\n", "a\n\n\nb\n\n\n", "x\nx\nx\nx", "é\nü\n", "é\nü"]
    got = {r["doc_id"]: (r["kept"], r["removed_lines"]) for r in lines.dedup_lines(docs(spark, texts)).collect()}
    assert got == dict(enumerate(without_pairs(texts)))
    assert all(got[i][0] == texts[i] for i in range(120, 125))


def test_line_dedup_of_null_and_repeated_ids(spark):
    texts = [(7, "a\nb\nc\nd"), (7, "e"), (7, None), (7, "x\na\nb"), (None, "c\nd\ny"), (None, "c\nd"), (3, "z\nb\nc")]
    rows = lines.dedup_lines(spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)).collect()
    got = Counter((r["doc_id"], r["kept"]) for r in rows)
    assert got == Counter([(7, "a\nd"), (7, "e"), (7, None), (7, "x\n"), (None, "y"), (None, ""), (3, "z\nb\nc")])


def test_chunks_shift_with_content():
    rng = random.Random(9)
    body = "".join(f"line {rng.randrange(10**6)} of text\n" for _ in range(200)).encode()
    cut = lambda t: {t[a:b] for a, b, _ in lines.chunks(t)}
    assert len(cut(body) & cut(b"new first line\n" + body)) >= len(cut(body)) - 3
    assert b"".join(body[a:b] for a, b, _ in lines.chunks(body)) == body


def test_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(11)
    plain = [f"v{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(plain) for _ in range(n))
    item = text(20)
    texts = [text(80) for _ in range(60)]
    texts += [texts[0], texts[1] + " extra", text(10) + " " + item, *[text(60) + " idiot scum trash" for _ in range(20)]]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(i >= 63)) for i in range(len(texts))], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    table, ids = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in pipeline.STAGES:
        out = stage(spark, table, str(tmp_path)).persist()
        ids.append((name, {r["doc_id"] for r in out.select("doc_id").collect()}))
        if name != "sharding":
            assert out.columns == table.columns
        table = out
    steps = dict(ids)
    assert steps["toxicity"] == set(range(63)) and steps["near-duplicates"] == set(range(60)) | {62} and steps["decontamination"] == set(range(60))
    assert steps["mixing"] <= steps["decontamination"] and steps["sharding"] == steps["mixing"]
    assert pipeline.run(spark, str(tmp_path)).count() == table.count()
