"""Odd rows through every operator and stage: nulls, empty and very long texts,
repeated rows, empty tables and further columns with clashing names."""

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridframe.llm import boosting, html_text, mixing, near_dups, neighbours, packing, queries, rules, sharding, store, toxicity
from gridframe.llm.common import staged_path
from gridframe.llm.labelled import training_sample

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
LONG = " ".join(f"{w}{i}" for i in range(9000) for w in WORDS[:3])
GOOD = [" ".join(f"{WORDS[(i * 7 + k * (1 + k % 5)) % 12]}{(i * k) % 97}" for k in range(80)) + "." for i in range(6)]
ROWS = (
    [(i, t, "en", "s1", len(t)) for i, t in enumerate(GOOD)]
    + [(6, GOOD[0], "en", "s1", 5), (6, GOOD[0], "en", "s1", 5), (7, GOOD[1].upper(), None, None, None)]
    + [(8, None, None, None, None), (9, "", "en", "s2", 0), (10, " \t\n ", "en", "s2", 4), (11, "two words", "en", "s2", 9), (12, LONG, "en", "s3", len(LONG)), (13, "x" * 300_000, "en", "s3", 1), (14, "é中\U0001f642 a\x1cb <|endoftext|>", "en", "s3", 1)]
)
KINDS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = {"n_words": 1, "kept": "x", "size": 2.5, "__key": 3, "id": 4, "v": 5, "root": 6, "length": 7, "score": 8, "label": 9, "bucket": 0, "copies": 1}


@pytest.fixture(scope="module", params=["odd", "clashing", "empty"])
def docs(spark, request):
    rows = spark.createDataFrame([] if request.param == "empty" else ROWS, KINDS).repartition(3)
    return rows.withColumns({k: F.lit(v) for k, v in CLASHES.items()}) if request.param == "clashing" else rows


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i == 3)) for i in range(12)] + [(3, 1, 1), (None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")


def ids(df, column="doc_id"):
    return sorted(r[0] for r in df.select(column).collect())


def expected(docs):
    return ids(docs)


def test_mixing(docs):
    out = mixing.weighted_fair_mix(docs.withColumn("__words", mixing.word_count()), "__words")
    assert ids(out) == expected(docs)
    for r in out.collect():
        assert 0 <= r["__copies"] <= 3 and (r["__words"] > 0 or r["__copies"] == 0)


def test_rules(docs):
    out = rules.host_rules(docs, F.col("source")).collect()
    assert sorted(r["doc_id"] for r in out) == expected(docs)
    for r in out:
        if r["doc_id"] in (8, 9, 10, 11):
            assert r["base_failed"] and not r["kept"]
    stay = rules.kept_documents(docs, "source")
    assert stay.columns == docs.columns
    assert ids(stay) == sorted(r["doc_id"] for r in out if r["kept"])


def test_near_duplicates(docs):
    out = near_dups.near_duplicates(docs).collect()
    assert sorted(r["doc_id"] for r in out) == expected(docs)
    by = {r["doc_id"]: r for r in out}
    if out:
        assert by[6]["component_id"] == 0 and by[7]["component_id"] == 1 and by[8]["n_shingles"] == 0
        assert all(by[i]["component_id"] == i for i in (0, 1, 8, 9, 10, 11, 12, 13, 14))
        assert by[11]["n_shingles"] == by[13]["n_shingles"] == 1
    stay = near_dups.one_of_each(docs)
    assert stay.columns == docs.columns and ids(stay) == sorted({r["doc_id"] for r in out if r["kept"]})


def test_near_duplicates_without_ids(spark):
    rows = spark.createDataFrame([(None, GOOD[0]), (5, GOOD[0]), (None, GOOD[2])], "doc_id long, text string")
    out = {(r["doc_id"], r["component_id"]): r["kept"] for r in near_dups.near_duplicates(rows).collect()}
    assert out == {(None, 5): False, (5, 5): True, (None, None): False}


def test_stage_links_from_80_percent(spark):
    words = [f"w{i}" for i in range(304)]
    near = words[:150] + ["z"] + words[151:]  # 5 of 300 shingles differ: 295 / 305 = 0.967
    between = [w if k not in (20, 60, 100, 140, 180, 220) else "x" for k, w in enumerate(words)]  # 30 of 300 differ: 270 / 330 = 0.818
    far = [w if k not in range(20, 220, 25) else "y" for k, w in enumerate(words)]  # 40 of 300 differ: 260 / 340 = 0.765
    rows = [(1, words), (2, near), (3, between), (4, far)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    assert near_dups.bands_for(85) == 20 and (1 - 0.8**5) ** near_dups.bands_for(80) <= 1e-5
    assert ids(corpus_pipeline.near_dedup(spark, docs, "")) == [1, 4]
    assert sorted(r["component_id"] for r in near_dups.near_duplicates(docs, 85).collect()) == [1, 1, 3, 4]


def test_sharding(docs):
    out = sharding.histogram_shards(docs, 4).collect()
    assert sorted(r["doc_id"] for r in out) == expected(docs)
    by: dict = {}
    for r in out:
        by.setdefault(r["__shard"], []).append(r["__slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


def test_sharding_cuts_a_large_group(spark):
    rows = [(i if i % 50 else None, "the text of a third of all rows") for i in range(300)] + [(1000 + i, f"another text {i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = sharding.histogram_shards(docs, 8).collect()
    size = {s: sum(r["__size"] for r in out if r["__shard"] == s) for s in range(8)}
    assert len(out) == 600 and max(size.values()) - min(size.values()) <= 0.05 * sum(size.values()) / 8 + 6 * 64
    again = sharding.histogram_shards(docs.repartition(3), 8).collect()
    assert sorted((r["doc_id"] or 0, r["__crc"], r["__shard"], r["__slot"]) for r in out) == sorted((r["doc_id"] or 0, r["__crc"], r["__shard"], r["__slot"]) for r in again)


def test_mix_of_ties_in_finish_order(spark):
    rows = [(i % 20 if i % 7 else None, "some words of text", "ab"[i % 2]) for i in range(80)] + [(500 + i, "other words " * (i % 5), None) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("__words", mixing.word_count())
    mixed = mixing.weighted_fair_mix(docs, "__words").collect()
    taken = sum(r["__copies"] * r["__words"] for r in mixed)
    assert len(mixed) == 110 and abs(taken - sum(r["__words"] for r in mixed)) <= max(r["__words"] for r in mixed)
    out = mixing.mixture(docs, "__words").collect()
    assert len(out) == sum(r["__copies"] for r in mixed)
    # In finish order every source has near its share of any prefix.
    target = {r["source"]: r["__target"] for r in mixed}
    half = out[: len(out) // 2]
    for s, t in target.items():
        assert abs(sum(r["__words"] for r in half if r["source"] == s) / t - 0.5) < 0.25


def test_packing_splits_a_common_length(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "one two three four five six") for i in range(100)], "doc_id long, text string").repartition(3)
    path = public_tokenizers.path("word_bpe_49k.json")
    monkeypatch.setattr(packing, "ROWS_A_RANGE", 7)
    out = packing.pack(docs, path, window=64).toPandas()
    assert len(out) == 100 and out["sequence_id"].nunique() == -(-100 // (64 // out["length"][0]))
    for _, own in out.sort_values("offset").groupby("sequence_id"):
        assert own["offset"].tolist() == (own["length"].cumsum() - own["length"]).tolist()


def test_many_hosts(spark, monkeypatch):
    docs = spark.createDataFrame([(i, GOOD[i % 6] if i % 3 else "bad", None if i % 5 == 0 else f"h{i % 11}") for i in range(66)], "doc_id long, text string, source string")
    few = sorted(map(tuple, rules.host_rules(docs, F.col("source")).collect()), key=lambda r: r[0])
    kept = ids(rules.kept_documents(docs, "source"))
    monkeypatch.setattr(rules, "BROADCAST_ROWS", 2)
    assert sorted(map(tuple, rules.host_rules(docs, F.col("source")).collect()), key=lambda r: r[0]) == few
    assert ids(rules.kept_documents(docs, "source")) == kept


def test_classifiers(docs, labels):
    training = training_sample(labels, "quality", F.lit(True), 100)
    out = boosting.quality_scores(docs, training).collect()
    assert sorted(r["doc_id"] for r in out) == expected(docs) and all(0 <= r["score"] <= 1 for r in out)
    stay = boosting.kept_documents(docs, training)
    assert stay.columns == docs.columns and ids(stay) == sorted(r["doc_id"] for r in out if r["score"] >= 0.5)
    model = toxicity.fit(toxicity.sample_texts(docs, training_sample(labels, "toxic", F.lit(True), 100)))
    out = toxicity.score(docs, model).collect()
    assert sorted(r["doc_id"] for r in out) == expected(docs) and all(0 <= r["score"] <= 1 for r in out)


def test_no_labels(docs, labels):
    none = training_sample(labels, "toxic", F.lit(False), 100)
    assert {r["score"] for r in boosting.quality_scores(docs, none).collect()} <= {0.5}
    assert len({r["score"] for r in toxicity.score(docs, toxicity.fit(toxicity.sample_texts(docs, none))).collect()}) <= 1


def test_packing(docs):
    out = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), window=256).collect()
    assert sorted({r["doc_id"] for r in out}) == sorted(set(expected(docs)))
    assert all(0 < r["length"] <= 256 for r in out)
    if out:
        assert [(r["length"], r["doc_tokens"]) for r in out if r["doc_id"] == 8] == [(1, 1)]


def test_store(spark, docs):
    path = staged_path(spark, "store")
    store.write_store(docs, path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    out = store.read_sums(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in out] == expected(docs)
    assert [r["start"] for r in out] == [sum(x["n_tokens"] for x in out[:k]) for k in range(len(out))]
    assert store.verify(spark, path)


def test_pages(spark):
    odd = [(0, "u", None), (1, None, ""), (2, "u", "<p>unclosed <b>bold <!-- never ends"), (3, "u", "< 3 && >"), (4, "u", "<p>" + "word " * 200_000 + "</p>"), (5, "u", "<article><p>A &amp; B</p></article>"), (5, "u", "<article><p>A &amp; B</p></article>")]
    pages = spark.createDataFrame(odd, "page_id long, url string, html string")
    for rows in (pages, pages.withColumn("text", F.lit("x")).withColumn("n_chars", F.lit("y")), pages.limit(0)):
        weights = html_text.fit_weights(html_text.labelled_items(rows, 10))
        out = {r["page_id"]: r for r in html_text.main_texts(rows, weights, also=("url",)).collect()}
        if out:
            assert out[0]["text"] == "" and out[1]["text"] == "" and out[5]["text"] == "A & B" and out[4]["n_chars"] == 999_999
            assert out[2]["text"] == "unclosed bold"


def test_vectors(spark):
    good = [(i, [float(i % 3), 1.0, float(i)]) for i in range(1, 9)]
    odd = [(20, None), (21, []), (22, [0.0, 0.0, 0.0]), (23, [1.0, None, 2.0]), (24, [float("nan"), 1.0, 1.0]), (25, [float("inf"), 1.0, 1.0]), (26, [1.0, 2.0]), (None, [1.0, 1.0, 1.0]), (1, [1.0, 1.0, 1.0])]
    rows = spark.createDataFrame(good + odd, "vec_id long, embedding array<double>")
    out = neighbours.search(rows.withColumns({"id": F.lit("x"), "rep": F.lit("y")}), F.col("vec_id") % 4 == 0, k=20).collect()
    assert {r["query_id"] for r in out} == {4, 8} and all(len([r for r in out if r["query_id"] == q]) == 7 for q in (4, 8))
    assert neighbours.search(rows.limit(0), F.col("vec_id") % 4 == 0).count() == 0
    assert neighbours.search(rows.where("vec_id > 19"), F.col("vec_id") % 4 == 0).count() == 0


def ranked(x, q, k):
    score = (x * x[q]).sum(axis=1)
    others = np.delete(np.arange(len(x)), q)
    return others[np.lexsort((others, -score[others]))[:k]].tolist()


@pytest.mark.parametrize("lengths", [[1.0] * 30, [1.0] * 1199 + [10.0], [2.0 ** (i % 9) for i in range(1200)], [1e-200] * 100 + [1.0] * 200 + [1e150] * 3])
def test_search_of_any_lengths(spark, lengths):
    x = np.random.default_rng(5).normal(size=(len(lengths), 64))
    x = x / np.sqrt((x * x).sum(1))[:, None] * np.array(lengths)[:, None]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    out = neighbours.search(rows, F.col("vec_id") % 10 == 0, k=20).orderBy("query_id", "rank").collect()
    hit = n = 0
    for q in range(0, len(x), 10):
        mine, true = [r["vec_id"] for r in out if r["query_id"] == q], ranked(x, q, 20)
        assert len(mine) == len(true) == 20
        hit, n = hit + len({*mine} & {*true}), n + 20
    assert hit / n >= 0.9


def test_search_of_ties(spark):
    x = np.array([[1.0, 0, 0], [0, 1, 0], [1, 1, 0]] * 30)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    out = neighbours.search(rows, F.col("vec_id") % 20 == 0, k=20).orderBy("query_id", "rank").collect()
    for q in range(0, 90, 20):
        assert [r["vec_id"] for r in out if r["query_id"] == q] == ranked(x, q, 20)


@pytest.mark.parametrize("stage", range(len(corpus_pipeline.STAGES)))
def test_stages(spark, docs, labels, tmp_path, stage):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    name, f = corpus_pipeline.STAGES[stage]
    out = f(spark, docs, str(tmp_path))
    if stage < len(corpus_pipeline.STAGES) - 1:
        assert out.columns == docs.columns
    assert set(ids(out)) <= set(expected(docs))


def test_every_operator_has_its_query():
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES) == list(range(1, 14))


def test_hot_keys_change_no_result(spark, monkeypatch):
    from gridframe.llm import common

    words = [f"w{i}" for i in range(60)]
    near = [(i, " ".join(w if k != i % 50 else "z" for k, w in enumerate(words))) for i in range(40)]
    rows = near + [(100 + i, "the same text in many documents of this table") for i in range(40)] + [(200 + i, f"{i} alone here") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    plain = sorted(map(tuple, near_dups.near_duplicates(docs).collect()))
    monkeypatch.setattr(common, "HOT_ROWS", 1)
    assert sorted(map(tuple, near_dups.near_duplicates(docs).collect())) == plain
    assert {r[2] for r in plain if 100 <= r[0] < 140} == {100} and {r[2] for r in plain if r[0] < 40} == {0}


def test_components_of_chains_and_hubs(spark, monkeypatch):
    from gridframe.llm import common
    from gridframe.llm.components import components

    monkeypatch.setattr(common, "HOT_ROWS", 20)
    edges = [(i, i + 1) for i in range(70)] + [(1000, 1001 + i) for i in range(60)] + [(2005, 2003), (2003, 2005), (2003, 2003)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(1, 71)}, **{1001 + i: 1000 for i in range(60)}, 2005: 2003}


def test_blocks_of_many_equal_sets():
    import time

    base = np.sort(np.random.default_rng(1).integers(0, 2**63, 20).astype(np.uint64))
    start = time.process_time()
    links = near_dups.block_links([base] * 60_000, list(range(60_000)), list(range(60_000)), 80)
    assert len(links) == 59_999 and time.process_time() - start < 20
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.choice(60, 12).astype(np.uint64)) for _ in range(150)]
    root = list(range(150))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(150):
        for j in range(i):
            if near_dups.similar(sets[i], sets[j], 80):
                root[find(i)] = find(j)
    want = [find(i) for i in range(150)]
    root = list(range(150))
    for i, j in near_dups.block_links(sets, list(range(150)), list(range(150)), 80):
        assert near_dups.similar(sets[i], sets[j], 80)
        root[find(i)] = find(j)
    got = [find(i) for i in range(150)]
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_large_buckets_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(near_dups, "CHUNK_BYTES", 2000)
    monkeypatch.setattr(near_dups, "SALT_BYTES", 2000)
    words = [f"w{i}" for i in range(110)]
    rows = [(i, " ".join(w if k % 100 != (i * 7) % 100 and k % 100 != (i * 13) % 100 else f"z{i % 5}" for k, w in enumerate(words))) for i in range(60)]
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(106)} for i, t in rows}
    root = dict(zip(sets, sets))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    out = near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 80).collect()
    assert {r["doc_id"]: r["component_id"] for r in out} == {i: find(i) for i in sets}


def test_one_of_each_without_ids(spark):
    rows = [(None, GOOD[0]), (None, GOOD[0]), (None, GOOD[2]), (5, GOOD[3]), (5, GOOD[4]), (6, GOOD[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["text"]) for r in near_dups.one_of_each(docs).collect()) == sorted([(0, GOOD[0]), (0, GOOD[2]), (5, GOOD[3]), (5, GOOD[4])])
