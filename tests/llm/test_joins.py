"""The conversation trie, hard negatives and the set join against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridframe.llm import hard_negatives, near_dups, prefix_trie, set_join

WORDS = [f"w{i}" for i in range(400)]


def trie_of(rows):
    """The contract's nodes, by rebuilding every conversation."""
    own: dict = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(r, t) for _, _, r, t in sorted(v, key=lambda x: (x[0], x[1], hashlib.md5(f"{len(x[2])}:{x[2]}{x[3]}".encode()).hexdigest()))] for c, v in own.items()}
    rebuilt = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = tuple(turns.get(c - int(np.fmod(c, 20)), [])[:h] + turns[c][h:])
    members: dict = {}
    for c, path in rebuilt.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    children: dict = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    out = []

    def below(node):
        leaves, saved = 0, (len(members[node]) - 1) * (len(node[-1][1].split(" ")) if node and node[-1][1] else 0)
        for child in children.get(node, []):
            a, b = below(child)
            leaves, saved = leaves + a, saved + b
        leaves = leaves or 1
        ends = sorted(c for c in members[node] if len(rebuilt[c]) == len(node))
        out.append((min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(children.get(node, [])), leaves, saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
        return leaves, saved

    if members:
        below(())
    return sorted(out, key=str)


def trie(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    df = df.withColumns({"k1": F.lit(1), "base": F.lit("x"), "depth": F.lit(0)})
    conv = F.col("conv_id")
    out = prefix_trie.prefix_trie(df, "conv_id", conv - conv % 20, F.crc32(conv.cast("string").cast("binary")) % 4, 3)
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, out.collect()), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_trie_against_brute_force(spark, seed, monkeypatch):
    rng = random.Random(seed)
    texts = ["", "a", "a b", "b c d", "same old words"]
    rows = [(c, None if rng.random() < 0.1 else k, rng.choice(["user", None]), rng.choice(texts) if rng.random() < 0.9 else None) for c in rng.sample(range(-45, 200), 90) for k in range(rng.choice([1, 1, 2, 3, 6, 9]))]
    rows += [(c, k, "user", "same old words") for c in range(400, 460) for k in range(5)]  # a third of all, alike
    rows += [(500, k, "user", f"turn {k}") for k in range(300)] + [(None, 0, "user", "x")] + rows[:20]
    monkeypatch.setattr(prefix_trie, "SPAN_BITS", 2)
    monkeypatch.setattr("gridframe.llm.common.HOT_ROWS", 5)
    assert trie(spark, rows) == trie_of(rows)


def test_trie_of_nothing(spark):
    assert trie(spark, []) == []
    assert trie(spark, [(None, 1, "user", "x")]) == []
    assert trie(spark, [(3, 1, "user", "x")]) == trie_of([(3, 1, "user", "x")])


def mined(rows):
    good = [(i, lab, v) for i, lab, v in rows if None not in (i, lab, v) and len(v) == 6 and all(x is not None and np.isfinite(x) and abs(x) < 1e6 for x in v)]
    ids = [i for i, _, _ in good]
    labels = [(lab + 1) % 10 if i % 7 == 0 else lab for i, lab, _ in good]
    x = np.array([np.floor(256 * np.array(v, np.float32).astype(float)) for _, _, v in good]).astype(np.int64)
    out = []
    for a in range(len(good)):
        if ids[a] % 10:
            continue
        s = x @ x[a]
        order = sorted((b for b in range(len(good)) if b != a), key=lambda b: (-s[b], ids[b]))
        for p in [b for b in order if labels[b] == labels[a]][:5]:
            far = [b for b in order if labels[b] != labels[a] and 80 * s[p] <= 100 * s[b] <= 100 * s[p]][:5]
            out += [(ids[a], ids[p], n, ids[b], int(s[p]), int(s[b])) for n, b in enumerate(far, 1)]
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_negatives_against_brute_force(spark, seed, monkeypatch):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, 6))
    rows = [(int(i), int(rng.integers(10)), [float(np.float32(x)) for x in centres[i % 8] + 0.3 * rng.normal(size=6)]) for i in range(300)]
    rows += [(300 + i, int(i % 2), rows[5][2]) for i in range(150)]  # a third of all, alike
    rows += rows[:12] + [(10, 3, rows[7][2]), (700, None, rows[1][2]), (710, 3, None), (720, 3, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (730, 3, [float("nan")] * 6), (740, 3, [1.0] * 5), (750, 3, []), (None, 3, rows[1][2]), (760, 3, [0.0] * 6), (770, 3, [1e30] * 6)]
    for name, n in (("GROUP_ROWS", 40), ("FIRST_ROWS", 30), ("ASKS_A_TASK", 7), ("LIST_ROWS", 20), ("CELLS", 500)):
        monkeypatch.setattr(hard_negatives, name, n)
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(4).withColumns({"key": F.lit(1), "group": F.lit("x"), "id": F.lit(7)})
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = hard_negatives.hard_negatives(df, F.col("id") % 10 == 0, label)
    assert sorted(map(tuple, got.collect())) == mined(rows)


def test_negatives_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert hard_negatives.hard_negatives(df, F.col("id") % 10 == 0, F.col("label")).count() == 0
    one = spark.createDataFrame([(0, 1, [1.0, 2.0])], "vec_id long, label int, embedding array<float>")
    assert hard_negatives.hard_negatives(one, F.col("id") % 10 == 0, F.col("label")).count() == 0


def test_products_are_exact():
    a = np.array([[2**26, -(2**26) + 1, 3]], np.int64)
    b = np.array([[2**26 - 1, 2**26, -7], [1, 2, 3]], np.int64)
    assert hard_negatives.products(a, b).tolist() == [[sum(int(x) * int(y) for x, y in zip(a[0], r)) for r in b]]


def shingle_set(text):
    w = (text or "").translate({c: c + 32 for c in range(65, 91)}).split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def linked(rows, percent):
    """doc_id, size and component of every row, links of an id's rows counted together."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if (sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j])) or (rows[i][0] is not None and rows[i][0] == rows[j][0]):
                root[find(i)] = find(j)
    least: dict = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted(((doc, len(sets[i]), least.get(find(i))) for i, (doc, _) in enumerate(rows)), key=str)


def changed(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = rng.choice(WORDS)
    return words


def corpus(seed):
    """Groups of copies whose members differ by degrees around the threshold, and texts
    that share passages."""
    rng = random.Random(seed)
    rows, passage = [], [rng.choice(WORDS) for _ in range(40)]
    for group in range(12):
        base = [rng.choice(WORDS) for _ in range(rng.choice([3, 5, 8, 60, 120]))]
        for k in range(rng.choice([1, 2, 6, 12])):
            rows.append(" ".join(changed(rng, base, rng.choice([0, 0, 1, 2, 3, 4]) if len(base) > 20 else 0)))
            base = changed(rng, base, 1) if k % 3 == 2 else base
    for _ in range(15):
        rows.append(" ".join([rng.choice(WORDS) for _ in range(rng.choice([10, 40, 160]))] + passage))
    rows += ["The License Line of all texts here"] * 30 + ["", None, " \t", "two words", "two words", "TWO words"]
    return [(i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("seed", range(3))
def test_set_join_against_brute_force(spark, seed, monkeypatch):
    rows = corpus(seed)
    rows += [(None, rows[0][1]), (None, "nothing like it")]
    monkeypatch.setattr("gridframe.llm.common.HOT_ROWS", 3)
    monkeypatch.setattr(near_dups, "CHUNK_BYTES", 3_000)
    monkeypatch.setattr(near_dups, "SALT_BYTES", 3_000)
    monkeypatch.setattr(set_join, "HOT", 3 + seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).withColumns({"n": F.lit(1), "doc": F.lit("x"), "__id": F.lit(0)})
    got = set_join.jaccard_join(docs, 80)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()), key=str) == linked(rows, 80)


def test_set_join_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert set_join.jaccard_join(docs).count() == 0
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(map(tuple, set_join.jaccard_join(docs).select("doc_id", "n_shingles", "component_id").collect())) == [(1, 0, 1), (2, 0, 2)]


@pytest.mark.parametrize("link", [set_join.jaccard_join, near_dups.near_duplicates])
def test_an_id_on_several_texts_links_them_all(spark, link):
    a, b = WORDS[:150], WORDS[200:350]
    near_a, near_b = [*a[:75], "z", *a[76:]], [*b[:75], "z", *b[76:]]
    rows = [(5, " ".join(a)), (5, " ".join(b)), (7, " ".join(near_a)), (8, " ".join(near_b)), (9, " ".join(WORDS[100:300])), (3, "alone"), (3, "alone"), (3, None), (5, "")]
    for parts in (1, 3, 5):
        out = link(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts), 80)
        assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out.collect()), key=str) == linked(rows, 80)


@pytest.mark.parametrize("seed", range(20))
def test_skipping_loses_no_link(seed):
    rng = random.Random(seed)
    groups = [[rng.randrange(10**6) for _ in range(rng.choice([5, 40, 80]))] for _ in range(6)]
    sets = [sorted({x if rng.random() > 0.06 else rng.randrange(10**6) for x in rng.choice(groups)}) for _ in range(40)]
    roots = [rng.randrange(12) for _ in sets]  # components known before
    root = {r: r for r in roots}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    true = {(i, j) for i in range(40) for j in range(i) if 100 * len({*sets[i]} & {*sets[j]}) >= 80 * len({*sets[i]} | {*sets[j]})}
    for i, j in true:
        root[find(roots[i])] = find(roots[j])
    want = [find(r) for r in roots]
    links = set_join.skip_links([np.array(s, np.uint64) for s in sets], list(range(40)), roots, 80)
    assert all(tuple(sorted(p, reverse=True)) in true for p in links)
    root = {r: r for r in roots}
    for i, j in links:
        root[find(roots[i])] = find(roots[j])
    got = [find(r) for r in roots]
    assert len({*zip(got, want)}) == len({*got}) == len({*want})


def test_search_over_many_groups(spark, monkeypatch):
    from gridframe.llm import neighbours

    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 12)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(600 + i, x[7].tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    full = np.concatenate([x, np.repeat(x[7:8], 60, axis=0)]).astype(float)
    hits = {}
    for block in (32, 4096):
        monkeypatch.setattr(neighbours, "BLOCK", block)
        out = neighbours.search(df, F.col("vec_id") % 20 == 0, k=10).toPandas()
        assert (out.groupby("query_id").size() == 10).all()
        found = 0
        for q, own in out.groupby("query_id"):
            score = full @ full[q]
            score[q] = -np.inf
            np.testing.assert_allclose(own["score"], score[own["vec_id"]], rtol=1e-12)
            found += len({*own["vec_id"]} & {*np.lexsort((np.arange(len(score)), -score))[:10].tolist()})
        hits[block] = out
        assert found >= 0.9 * len(out)
    key = ["query_id", "rank"]
    assert hits[32].sort_values(key)["vec_id"].tolist() == hits[4096].sort_values(key)["vec_id"].tolist()


def test_entries_that_similar_sets_share(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(400):
        n = rng.choice([1, 2, 5, 9, 20, 60, 130])
        a = sorted(rng.sample(range(5000), n))
        b = sorted(set(rng.sample(a, n - rng.randrange(n // 8 + 1))) | set(rng.sample(range(5000), rng.randrange(n // 8 + 1))))
        if 100 * len({*a} & {*b}) >= 80 * len({*a} | {*b}):
            first = [x[: len(x) - -(-80 * len(x) // 100) + set_join.shared(len(x))] for x in (a, b)]
            rows.append((len(a), len(b), len({*first[0]} & {*first[1]})))
    assert len(rows) > 100
    df = spark.createDataFrame(rows, "n long, m long, k long")
    assert df.where(F.col("k") < set_join.shared_of(F.col("n"), F.col("m"), 80)).count() == 0
    assert df.where((F.col("k") < set_join.least_shared(80)) | (set_join.shared_of(F.col("n"), F.col("m"), 80) < set_join.least_shared(80))).count() == 0


def test_lists_of_much_the_same_sets_are_joined(spark):
    rng = random.Random(2)
    near = {f"a{k}": rng.sample(range(90), 80) for k in range(30)}  # 90 components that meet in 30 lists
    apart = {f"b{k}": range(1000 + 70 * k, 1070 + 70 * k) for k in range(3)}
    chain = {f"c{k}": range(2000 + 69 * k, 2070 + 69 * k) for k in range(3)}  # joined, they had more pairs
    rows = [(zlib.crc32(b.encode()), doc, doc, 100) for b, docs in (near | apart | chain).items() for doc in docs]
    df = spark.createDataFrame(rows, "bucket long, doc long, root long, n long")
    out = [tuple(r) for r in near_dups.meeting(df, 80, lambda n, low, high: F.lit(1), []).collect()]
    assert len(out) == len({*out})

    def lists(rows):
        found = {}
        for bucket, doc, *_ in rows:
            found.setdefault(bucket, set()).add(doc)
        return sorted(map(sorted, found.values()))

    got, want = lists(out), lists(rows)
    assert all(any({*w} <= {*g} for g in got) for w in want)
    assert sum(len(g) ** 2 for g in got) <= sum(len(w) ** 2 for w in want)
    assert len([g for g in got if g[0] < 1000]) <= 3 and [g for g in got if g[0] >= 1000] == [w for w in want if w[0] >= 1000]


def test_entries_shared_with_sets_of_a_range_of_sizes(spark):
    def shared_by(n, m):
        return -(-80 * (n + m) // 180) - max(-(-80 * k // 100) - 1 - k // 10 for k in (n, m))

    rows = []
    for n in range(1, 130):
        sizes = range(-(-80 * n // 100), 100 * n // 80 + 1)
        rows += [(n, low, high, min(shared_by(n, m) for m in range(low, high + 1))) for low in sizes for high in sizes if low <= high and (low + high + n) % 3 == 0]
    df = spark.createDataFrame(rows, "n long, low long, high long, least long")
    how = set_join.shared_in_range(F.col("n"), F.col("low"), F.col("high"), 80)
    assert df.where(how > F.col("least")).count() == 0
    assert df.where(how < F.col("least") - 2).count() == 0
    # 80 shingles and 99 may share 10 entries, 80 and 90 share 14, 80 and 100 share 11.
    rows = [(k, doc, root, n) for k in range(10) for doc, root, n in [(1, 1, 80), (2, 2, 99)]] + [(0, 3, 2, 90), (0, 4, 2, 100)]
    df = spark.createDataFrame(rows, "bucket long, doc long, root long, n long")
    out = near_dups.meeting(df, 80, lambda n, low, high: set_join.shared_in_range(n, low, high, 80), [])
    assert {1, 2} <= {r["doc"] for r in out.collect()}


def test_set_join_of_joined_lists_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near_dups, "MOST_ROOTS", 1)
    rows = corpus(7)
    got = set_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 80)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()), key=str) == linked(rows, 80)
