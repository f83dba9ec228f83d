"""The operators' queries against brute force, on the smallest tables."""

import itertools
import random
import re
import unicodedata
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from gridframe.llm import packing, queries, rules, store
from gridframe.llm.common import WORD

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def tables():
    names = ("documents", "embeddings", "pages", "labels", "conversations")
    return {t: duckdb.sql(f"select * from read_parquet('{SF}/{t}.parquet') order by 1").df() for t in names}


@pytest.fixture(scope="module")
def run(spark):
    made = {}
    return lambda name: made[name] if name in made else made.setdefault(name, queries.QUERIES[name](spark, SF).toPandas())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(run, tables, name):
    con = duckdb.connect()
    for t in tables:
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    got, want = run(name), con.sql(queries.ORACLE_SQL[name]).df()
    key = sorted(got.columns)
    pd.testing.assert_frame_equal(got[key].sort_values(key).reset_index(drop=True), want[key].sort_values(key).reset_index(drop=True), check_dtype=False, check_exact=True)


def test_mix_meets_targets(run):
    out = run("op1_fair_mix")
    for (_, target), own in out.groupby(["source_size", "target"]):
        sources = own["size"].sum() / own["source_size"].iloc[0]  # sources of one size share a row here
        assert abs(own["taken"].sum() - sources * target) <= 3 * own["size"].max()
    assert abs(out["taken"].sum() - out["size"].sum()) <= 3 * out["size"].max()
    assert (out["taken"] <= 3 * out["size"]).all() and (out["taken"] % out["size"].clip(lower=1) == 0).all()


def shingles(text):
    w = text.encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_near_duplicates(run, tables):
    docs = tables["documents"]
    sets = dict(zip(docs["doc_id"], map(shingles, docs["text"])))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    out = run("op3_circulant_minhash").set_index("doc_id")
    assert {i: find(i) for i in sets} == out["component_id"].to_dict()
    assert {i: len(s) for i, s in sets.items()} == out["n_shingles"].to_dict()
    assert (out["kept"] == (out.index == out["component_id"])).all()


def test_pages(run, tables):
    import html
    import re

    out = run("op4_best_run_html").set_index("page_id")["text"]
    for page, source in zip(tables["pages"]["page_id"], tables["pages"]["html"]):
        inside = re.search(r"<article>(.*?)</article>", source, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", inside)]
        assert out[page] == "\n\n".join(x for x in blocks if x)


def sentences(n, what="article"):
    return "".join(f"<p>This is sentence {i} of the {what}, with some words in it.</p>" for i in range(n))


@pytest.fixture(scope="module")
def page_weights(tables):
    from gridframe.llm import html_text

    return html_text.fit_weights([(p.kinds, p.amounts, *p.main) for p in map(html_text.read_page, tables["pages"]["html"]) if p.main])


def test_learnt_weights_decide(tables, page_weights):
    from gridframe.llm import html_text

    sources = tables["pages"]["html"].tolist()
    learnt = [html_text.extract(s, page_weights) for s in sources]
    assert sum(a != html_text.extract(s, html_text.FLAT) for a, s in zip(learnt, sources)) > 0.9 * len(sources)
    renamed = [s.replace("<article>", "<div>").replace("</article>", "</div>") for s in sources]
    assert [html_text.extract(s, page_weights) for s in renamed] == learnt


@pytest.mark.parametrize("name", ["legal-text", "search-content", "banner-text", "notice-panel"])
def test_article_under_a_marked_class_stays(page_weights, name):
    from gridframe.llm.html_text import extract

    page = f'<body><nav><a href=x>one</a></nav><div class="{name}">{sentences(40)}</div><footer>All rights reserved.</footer></body>'
    assert extract(page, page_weights).split("\n\n") == [f"This is sentence {i} of the article, with some words in it." for i in range(40)]
    beside = f'<body><div>{sentences(40)}</div><div class="{name}">Some words of a notice here.</div></body>'
    assert extract(beside, page_weights).count("\n\n") == 39


def test_parts_of_an_article(page_weights):
    from gridframe.llm.html_text import extract

    contents = "<ul>" + "".join(f"<li><a href=#>Part {i}</a></li>" for i in range(8)) + "</ul>"
    hidden = "<div class=ad>Buy now cheap</div><div style='display:none'>secret words <div>and more</div> here</div><span hidden>x <span>y</span> z</span>"
    remarks = "<div class=comments>" + "<div><p>I like it so much</p></div>" * 20 + "</div>"
    got = extract(f"<article><h1>T</h1><p>An intro of some words.</p>{contents}{sentences(5)}{hidden}<p>The end.</p>{remarks}</article>", page_weights).split("\n\n")
    assert got == ["T", "An intro of some words.", *(f"Part {i}" for i in range(8)), *(f"This is sentence {i} of the article, with some words in it." for i in range(5)), "The end."]
    assert extract(f"<form><div>{sentences(9)}</div><button>Send</button></form>", page_weights).count("\n\n") == 8


@pytest.mark.parametrize("broken", ["<a ", '<a "', "'<a '", '<a ">"', "</script", "<!--", "<p class='", "<div>", "</div>", "<div></x>", "<b hidden>", "<script>", "a=" * 9])
def test_broken_markup_in_linear_time(page_weights, broken):
    import time

    from gridframe.llm.html_text import extract

    extract(broken * 100, page_weights)
    took = []
    for size in (100_000, 800_000):
        start = time.process_time()
        extract(broken * (size // len(broken)) + ">", page_weights)
        took.append(time.process_time() - start)
    assert took[1] < 24 * took[0] + 0.5


def test_search(run, tables):
    x = np.stack(tables["embeddings"]["embedding"].to_numpy()).astype(float)
    ids, out = tables["embeddings"]["vec_id"].to_numpy(), run("op5_multiprobe_search")
    hit = n = 0
    for q in np.flatnonzero(ids % 20 == 0):
        score = (x * x[q]).sum(axis=1)
        others = np.flatnonzero(ids != ids[q])
        true = others[np.lexsort((ids[others], -score[others]))[:20]]
        own = out[out["query_id"] == ids[q]].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 21)) and own["score"].is_monotonic_decreasing
        np.testing.assert_array_equal(own["score"], score[own["vec_id"]])
        hit, n = hit + len(set(ids[true]) & set(own["vec_id"])), n + 20
    assert hit / n >= 0.9


def test_shards(run, tables):
    docs, out = tables["documents"].set_index("doc_id"), run("op6_histogram_shards").set_index("doc_id")
    raw = docs["text"].str.encode("utf-8")
    assert out["size"].to_dict() == (raw.map(len) + 16).to_dict() and out["text_crc32"].to_dict() == raw.map(zlib.crc32).to_dict()
    for _, own in out.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))
    share = out["size"].sum() / 40
    held = out.groupby("shard")["size"].sum().reindex(range(40), fill_value=0)
    assert (abs(held - share) <= out["size"].max() + 0.05 * share).all()
    # In the order of shard and slot, equal texts lie together, cut only where a group is large.
    order = out.sort_values(["shard", "slot"]).join(raw.rename("raw"))
    assert sum(a != b for a, b in zip(order["raw"], order["raw"][1:])) == order["raw"].nunique() - 1


def test_rules(run, tables):
    out = run("op7_host_rules").set_index("doc_id")
    for i, text in zip(tables["documents"]["doc_id"], tables["documents"]["text"]):
        w = WORD.findall(text)
        windows = Counter(zip(w, w[1:], w[2:]))
        covered = {k + j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        r = out.loc[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text))
        assert (r["n_dup_lines"], r["n_repeat_words"]) == (len(lines) - len(set(lines)), len(covered))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r["base_failed"] and r["kept"])


@pytest.mark.parametrize(
    ("name", "label", "folds", "held", "cut", "area", "precision", "recall"),
    [("op8_boosted_quality", "quality", 3, 1, 0.5, 0.97, 0.9, 0.9), ("op2_toxicity", "toxic", 4, 2, 0.3, 0.9, 0.85, 0.85)],
)
def test_classifiers(spark, name, label, folds, held, cut, area, precision, recall):
    sf = SF.replace("0.001", "0.01")
    out = queries.QUERIES[name](spark, sf).toPandas()
    assert all((zlib.crc32(str(i).encode()) % folds == held) == h for i, h in zip(out["doc_id"], out["held_out"]))
    assert ((out["score"] >= cut) == (out["predicted"] == 1)).all()
    both = out.merge(duckdb.sql(f"select * from read_parquet('{sf}/labels.parquet')").df(), on="doc_id")
    both = both[both["held_out"]]
    rank, bad, said = both["score"].rank(), both[label] == 1, both["predicted"] == 1
    auc = (rank[bad].sum() - bad.sum() * (bad.sum() + 1) / 2) / (bad.sum() * (~bad).sum())
    assert auc >= area
    assert (said & bad).sum() >= precision * said.sum() and (said & bad).sum() >= recall * bad.sum()


def shared_strings(a, b):
    """The kernel by listing all subsequences of three and of four characters."""

    def weighed(s):
        out = Counter()
        for order in (3, 4):
            for places in itertools.combinations(range(len(s)), order):
                out["".join(s[i] for i in places)] += 0.5 ** (places[-1] - places[0] - order + 1)
        return out

    x, y = weighed(a), weighed(b)
    return sum(x[u] * y[u] for u in x.keys() & y.keys())


def test_kernel_against_enumeration():
    from gridframe.llm.toxicity import Folded, kernel

    rng = random.Random(5)
    strings = [" idiot ", "i-d-i-o-t", "", "ab", "abc", "\U0001f642id\U0001f642iot", *("".join(rng.choices("abc idot", k=rng.randrange(3, 24))) for _ in range(30))]
    landmarks = [" idiot ", "stupid", "abcabc", "dot", "\U0001f642iot"]
    want = np.array([[shared_strings(s, m) for m in landmarks] for s in strings])
    np.testing.assert_allclose(kernel(strings, landmarks), want, rtol=1e-5)
    weights = np.array([0.7, -0.4, 0.1, 0.2, 1.5])
    folded = Folded(landmarks, weights)
    np.testing.assert_allclose(folded.values(strings), want @ weights, atol=1e-3)
    assert [folded.values([s])[0] for s in strings] == folded.values(strings).tolist()
    many = ["".join(map(chr, range(0x4E00 + 20 * k, 0x4E00 + 20 * k + 20))) for k in range(5)]  # of too many letters for tables
    np.testing.assert_allclose(Folded(many, weights).values([*strings, many[0][:9]]), kernel([*strings, many[0][:9]], many) @ weights, rtol=1e-5)


def test_toxicity_scores_stand_alone(spark, tables):
    from gridframe.llm import toxicity

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    landmarks = [" idiot ", " stupid ", "\U0001f4a9\U0001f4a9\U0001f4a9"]
    model = toxicity.Model(landmarks, np.array([0.05, 0.05, 0.5], np.float32), -0.2, slope=1.5, prior=-2.0)
    texts = ["zzz idle", "idiot x", None, "", "s t u p i d", "\U0001f4a9\U0001f4a9-\U0001f4a9", *tables["documents"]["text"].head(60)]
    alone = [float(toxicity.Model(landmarks, model.weights, -0.2, slope=1.5, prior=-2.0).scores([t])[0]) for t in texts]
    assert alone == model.scores(texts).tolist() == model.scores(texts[::-1]).tolist()[::-1]
    one, many = ({r["doc_id"]: r["score"] for r in toxicity.score(docs.repartition(n), model).collect()} for n in (1, 7))
    assert one == many and alone[4] > alone[2] == alone[3] < alone[5]


def test_toxicity_tolerates_spoilt_insults():
    from gridframe.llm.toxicity import Bare, Model, kernel

    own = kernel([" idiot "], [" idiot "])[0, 0]
    like = kernel([" idxiot ", " idiiot ", " thonre "], [" idiot "])[:, 0] / own
    assert like[0] > 0.4 and like[1] > 0.8 and like[2] < 0.05
    landmarks = [" idiot ", " scum "]
    own = kernel(landmarks, landmarks).diagonal()
    model = Model(landmarks, (1 / own).astype(np.float32), -0.25, slope=3.0, prior=-1.0)
    plain, spoilt = "you idiot here", ["i--d--i--o--t", "i**d**i**o**t", "i...d...i...o...t", "sc--um", "s--c--u--m", "iiidddiiiooottt", "i d i o t", "idxiot", "1diot"]
    low, *high = model.scores(["nothing at all", plain, *(f"you {x} here" for x in spoilt)])
    assert low < 0.3 and min(high) > low
    assert min(high[:7]) > 0.5
    strings = [" 77idiot99 ", "id\u00e9\u00e9iot", "zz", " s-c-u-m "]
    np.testing.assert_array_equal(kernel(Bare(landmarks).forms(strings), landmarks), kernel(strings, landmarks))


def test_trees_against_walks():
    from gridframe.llm import boosting

    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(400, len(boosting.FEATURES))), 1).astype(np.float32)
    y = (x[:, 3] + 0.5 * x[:, 7] > 0.2).astype(float)
    forest = boosting.fit(x, y)

    def walk(row):
        total = forest.start
        for f, t, leaf in zip(forest.feature, forest.threshold, forest.leaf):
            node = 0
            while node < len(f):
                node = 2 * node + 2 if row[f[node]] > t[node] else 2 * node + 1
            total += leaf[node - len(f)]
        return 1 / (1 + np.exp(-total))

    np.testing.assert_allclose(forest.scores(x), [walk(r) for r in x], rtol=1e-12)
    assert ((forest.scores(x) > 0.5) == (y == 1)).mean() > 0.97
    np.testing.assert_array_equal(forest.scores(x), np.concatenate([forest.scores(x[i : i + 1]) for i in range(len(x))]))
    # The first split by trying every value of every feature: few values, so bins hold one each.
    p = y.mean()
    g, h = p - y, np.full(len(y), p * (1 - p))

    def gain(mask):
        if h[mask].sum() < boosting.LEAST or h[~mask].sum() < boosting.LEAST:
            return -np.inf
        part = lambda m: g[m].sum() ** 2 / (h[m].sum() + boosting.RIDGE)
        return part(mask) + part(~mask) - part(np.ones(len(y), bool))

    best = max(((gain(x[:, f] <= v), f) for f in range(x.shape[1]) for v in np.unique(x[:, f])[:-1]), key=lambda z: z[0])
    assert best[1] == forest.feature[0, 0]
    assert gain(x[:, best[1]] <= forest.threshold[0, 0]) == pytest.approx(best[0])


def encoded(tables, name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    docs = tables["documents"]
    return {i: np.array([*e.ids, 2], "<u4") for i, e in zip(docs["doc_id"], t.encode_batch(docs["text"].tolist(), add_special_tokens=False))}


def test_store(spark, run, tables, tmp_path):
    ids, out = encoded(tables, "byte_bpe_50k.json"), run("op9_chunk_store").sort_values("doc_id")
    n = np.array([len(ids[i]) for i in sorted(ids)])
    assert out["doc_id"].tolist() == sorted(ids) and out["n_tokens"].tolist() == n.tolist() and out["start"].tolist() == (np.cumsum(n) - n).tolist()
    assert out["ids_crc32"].tolist() == [zlib.crc32(ids[i].tobytes()) for i in sorted(ids)]
    path = str(tmp_path / "store")
    store.write_store(spark.read.parquet(f"{SF}/documents.parquet"), path, public_tokenizers.path("byte_bpe_50k.json"), 2)
    whole = {r["doc_id"]: bytes(r["ids"]) for r in store.read_ids(spark, path).collect()}
    assert whole == {i: x.tobytes() for i, x in ids.items()}
    assert store.verify(spark, path)


@pytest.mark.parametrize("harm", ["chunk", "missing", "recipe", "doc_id", "start", "n_tokens", "root", "before", "manifest"])
def test_store_finds_tampering(spark, tmp_path, harm):
    docs = spark.createDataFrame([(i, f"words {i} of a text " * (40 * i + 1)) for i in range(6)] + [(None, None)], "doc_id long, text string").repartition(2)
    path, other = str(tmp_path / "store"), str(tmp_path / "harmed")
    store.write_store(docs, path, public_tokenizers.path("byte_bpe_50k.json"), 2)
    assert store.verify(spark, path)
    kept = {t: spark.read.parquet(f"{path}/{t}") for t in ("chunks", "recipes", "manifest")}
    five = F.col("doc_id") == 5
    if harm == "chunk":
        kept["chunks"] = kept["chunks"].withColumn("ids", F.when(F.length("ids") == kept["chunks"].agg(F.max(F.length("ids"))).first()[0], F.reverse(F.col("ids").cast("string")).cast("binary")).otherwise(F.col("ids")))
    elif harm == "missing":
        kept["chunks"] = kept["chunks"].where(F.col("hi") != kept["chunks"].agg(F.max("hi")).first()[0])
    elif harm == "recipe":
        three = kept["recipes"].where("doc_id = 3").first()
        kept["recipes"] = kept["recipes"].withColumn("chunks", F.when(five, F.lit(bytes(three["chunks"]))).otherwise(F.col("chunks")))
    elif harm in ("doc_id", "start", "n_tokens"):
        kept["recipes"] = kept["recipes"].withColumn(harm, F.when(five, F.col(harm) + 1).otherwise(F.col(harm)))
    elif harm == "root":
        kept["recipes"] = kept["recipes"].withColumn("root", F.when(five, F.lit(bytes(16))).otherwise(F.col("root")))
    elif harm == "before":
        kept["manifest"] = kept["manifest"].withColumn("before", F.col("before") + 1)
    else:
        kept["manifest"] = kept["manifest"].withColumn("root", F.when(F.col("part") >= 0, F.lit(bytes(16))).otherwise(F.col("root")))
    for t, rows in kept.items():
        rows.write.parquet(f"{other}/{t}")
    assert not store.verify(spark, other)


def test_store_splits_hot_chunks_and_guards_ids(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "HOT_HOLDERS", 2)
    docs = spark.createDataFrame([(i, "the same text " * 300 + str(i)) for i in range(40)], "doc_id long, text string").repartition(8)
    path, tokenizer = str(tmp_path / "store"), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    store.write_store(docs, path, public_tokenizers.path("byte_bpe_50k.json"), 2)
    want = {r["doc_id"]: np.array([*tokenizer.encode(r["text"], add_special_tokens=False).ids, 2], "<u4").tobytes() for r in docs.collect()}
    assert {r["doc_id"]: bytes(r["ids"]) for r in store.read_ids(spark, path).collect()} == want
    assert {r["doc_id"]: r["ids_crc32"] for r in store.read_sums(spark, path).collect()} == {i: zlib.crc32(x) for i, x in want.items()}
    with pytest.raises(Exception, match="does not fit"):
        store.write_store(docs, str(tmp_path / "narrow"), public_tokenizers.path("byte_bpe_50k.json"), 70_000)


def test_crc_shift():
    a, b = b"some bytes", b"and others, more of them"
    moved = store.shift_crc(np.array([zlib.crc32(a), zlib.crc32(b)]), np.array([len(b), 0]))
    assert int(moved[0] ^ moved[1]) == zlib.crc32(a + b)


def test_packing(run, tables):
    ids, out = encoded(tables, "word_bpe_49k.json"), run("op10_nnls_pack")
    seen = {i: np.zeros(len(x), int) for i, x in ids.items()}
    for r in out.itertuples():
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert len(piece) == r.length and zlib.crc32(piece.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        seen[r.doc_id][r.start : r.start + r.length] += 1
    assert all((x == 1).all() for x in seen.values())
    for _, own in out.sort_values("offset").groupby("sequence_id"):
        assert own["offset"].tolist() == (own["length"].cumsum() - own["length"]).tolist() and own["length"].sum() <= 4096
    used = out.groupby("sequence_id")["length"].sum()
    padded = used.where((used & (used - 1)) == 0, 4096)
    assert padded.sum() / used.sum() < 1.05


def exact_nnls(a, h):
    """By trying every set of positive columns."""
    best = h @ h
    for k in range(1, min(a.shape) + 1):
        for own in itertools.combinations(range(a.shape[1]), k):
            x, *_ = np.linalg.lstsq(a[:, own], h, rcond=None)
            if (x >= -1e-9).all():
                best = min(best, ((a[:, own] @ x - h) ** 2).sum())
    return best


@pytest.mark.parametrize("seed", range(6))
def test_solution_is_that_of_least_squares(seed):
    rng = np.random.default_rng(seed)
    lengths = sorted(rng.choice(np.arange(1, 16), 6, replace=False).tolist())
    histogram = {k: int(rng.integers(1, 9)) for k in lengths}
    columns = [tuple(rng.choice(lengths, rng.integers(1, 4)).tolist()) for _ in range(8)]
    a = np.array([[c.count(k) for c in columns] for k in lengths], float)
    x, h = np.array(packing.solve(histogram, columns)), np.array([histogram[k] for k in lengths], float)
    assert (x >= 0).all()
    assert ((a @ x - h) ** 2).sum() <= exact_nnls(a, h) + 1e-3


@pytest.mark.parametrize("kind", ["short", "mixed", "sparse"])
def test_solved_combinations_place_most_tokens(kind):
    rng, window = np.random.default_rng(7), 512
    lengths = {"short": rng.integers(5, 90, 4000), "mixed": rng.geometric(1 / 120, 4000).clip(1, 512), "sparse": rng.choice([100, 130, 256, 57, 12], 600)}[kind]
    histogram = {int(k): int(n) for k, n in Counter(lengths.tolist()).items()}
    columns = packing.combinations(histogram, window)
    assert columns and all(sum(c) == window for c in columns)
    left = {k: float(v) for k, v in histogram.items()}
    for x, c in zip(packing.solve(histogram, columns), columns):
        for k in c:
            left[k] -= x
    if kind != "sparse":
        assert sum(v * v for v in left.values()) <= 0.01 * sum(v * v for v in histogram.values())
    made, rest = packing.solved(histogram, window)
    placed = sum(sum(c) * n for c, n in made)
    total = sum(k * n for k, n in histogram.items())
    assert placed + sum(k * n for k, n in rest.items()) == total and (kind == "sparse" or placed >= 0.95 * total)
    used = Counter()
    for c, n in packing.plan(histogram, window):
        assert sum(c) <= window
        for k in c:
            used[k] += n
    assert used == Counter(histogram)


def test_a_bad_host_rejects_what_fails_a_rule(spark):
    words = [f"word{i}" for i in range(300)]
    clean = lambda i: " ".join(words[i % 200 : i % 200 + 80])
    failing = lambda i: clean(i) + " #$%&" * 30  # noqa: E731  a base rule of none, but many symbols
    rows = [(i, failing(i) if (i % 10 < 6 if i < 100 else i % 10 < 1) else clean(i), "bad" if i < 100 else f"h{i % 4}" if i % 7 else None) for i in range(700)]
    rows += [(700 + i, failing(i), f"small{i}") for i in range(3)]  # hosts of one document aren't judged by it
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r["doc_id"]: r for r in rules.host_rules(docs, F.col("source")).collect()}
    assert {r["host"] for r in out.values() if r["strict"]} == {"bad"}
    rejected = {i for i, r in out.items() if not r["kept"]}
    assert rejected == {i for i, t, h in rows if h == "bad" and "#" in t} and len(rejected) == 60
    assert {r["doc_id"] for r in rules.kept_documents(docs, "source").collect()} == set(out) - rejected
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    assert {r[0] for r in con.sql(f"SELECT doc_id FROM ({queries.OP7_SQL}) WHERE NOT kept").fetchall()} == rejected


def test_landmarks_of_many_scripts():
    from gridframe.llm.toxicity import Folded, kernel

    landmarks = ["".join(chr(a + 7 * i + k) for k in range(6)) for i, a in enumerate([0x61, 0x400, 0x3B1, 0x5D0, 0x905, 0x4E00, 0xAC00, 0x10D0, 0x531, 0x621, 0xE01, 0x3041, 0x30A1])]
    assert len({c for m in landmarks for c in m}) > 70
    weights = np.linspace(-1, 1, len(landmarks)).round(2)
    strings = [*landmarks, landmarks[1][:4] + "x" + landmarks[1][4:], landmarks[5][::-1], "abc", "a"]
    np.testing.assert_allclose(Folded(landmarks, weights).values(strings), kernel(strings, landmarks) @ weights, rtol=1e-5, atol=1e-5)


def test_class_names_of_any_length():
    from gridframe.llm.html_text import marks

    assert marks('class="sidebar' + "-links" * 40 + '"', True) == (False, True)
    assert marks('class="sidebar' + "-links" * 5000 + '!"', True) == (False, False)
    assert marks('id="advert' + "1" * 5000 + 'x"', True) == (False, False)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_piecewise_encoding_is_exact(name):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    from gridframe.llm.tokens import encoder

    made = encoder(public_tokenizers.path(name))

    @settings(max_examples=300, deadline=None)
    @given(st.text(st.sampled_from(list("abé\u0301 \n\t.,'s’ß1²中\x1c\x7f\x01-_AZİΣ")), max_size=40))
    def check(text):
        assert made.ids([text]) == made._encode([text])

    check()
    # Every character below U+0100 and some of each Unicode class, in random order.
    classes: dict[str, list[str]] = {}
    for c in map(chr, (*range(0xD800), *range(0xE000, 0x110000))):
        classes.setdefault(unicodedata.category(c), []).append(c)
    rng = random.Random(11)
    low = list(map(chr, range(256)))
    mixed = low + [c for own in classes.values() for c in rng.sample(own, min(6, len(own)))]
    texts = ["".join(rng.choices(rng.choice((low[:128], low, mixed)), k=rng.randrange(1, 30))) for _ in range(20_000)]
    assert made.ids(texts) == made._encode(texts)
    for text in ("x,\x7fa", "1?\x01À", "b-\x7f 文", "[\x1b[0m"):
        assert made.ids([text]) == made._encode([text])


def test_new_pieces_of_letters_are_merged_by_the_model_alone():
    from gridframe.llm.tokens import LETTERS, PieceEncoder, Pieces

    made = PieceEncoder(public_tokenizers.path("byte_bpe_50k.json"), 1000)
    letters = [c for c in map(chr, range(256)) if re.fullmatch(f"[{LETTERS}]", c)]
    rng = random.Random(4)
    pieces = [" " + "".join(rng.choices(letters, k=rng.randrange(1, 30))) for _ in range(3000)] + [" " + c for c in letters] + [" the", " naïve"]
    assert made._merge(pieces) == made._encode(pieces)
    signs = [" " + "".join(rng.choices([*letters, *"'1.,-²文"], k=rng.randrange(1, 30))) for _ in range(3000)]
    assert made._encode_lines(signs) == made._encode(signs)
    whole = []
    made._encode_lines = made._encode_joined = lambda part: whole.extend(part)
    made.ids(["the quick naïve fox"])
    assert not whole
    known = Pieces()
    assert known["new"] is known["new"] and "new" in known  # asked for once


def test_pipeline(spark, tables):
    kept = {}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = spark.createDataFrame(stage(spark, docs, SF).toPandas(), docs.schema)
        kept[name] = set(docs.toPandas()["doc_id"])
    rules = queries.op7_host_rules(spark, SF).toPandas()
    assert kept["quality_rules"] == set(rules[rules["kept"]]["doc_id"])
    assert kept["near_dedup"] <= kept["quality_classifier"] <= kept["quality_rules"]
    sets = {i: shingles(t) for i, t in zip(tables["documents"]["doc_id"], tables["documents"]["text"]) if i in kept["near_dedup"]}
    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        assert 100 * both < 80 * (len(sets[a]) + len(sets[b]) - both)
    # The mix takes each document as often as op1's SQL on what is kept, and packing
    # places every id of every copy once.
    rest = docs.toPandas()
    con = duckdb.connect()
    con.register("documents", rest)
    taken = con.sql(queries.OP1_SQL).df()
    copies = {r.doc_id: r.taken // r.size for r in taken.itertuples(index=False) if r.taken} if len(taken) else {}
    mixed = corpus_pipeline.mix_sources(spark, docs, SF)
    assert mixed.columns == docs.columns and Counter(mixed.toPandas()["doc_id"]) == Counter(copies)
    out = corpus_pipeline.run(spark, SF).toPandas()
    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    pieces = Counter()
    for i, text in zip(rest["doc_id"], rest["text"]):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        for at in range(0, len(ids), 4096):
            pieces[i, at, zlib.crc32(ids[at : at + 4096].tobytes())] += copies.get(i, 0)
    assert Counter(zip(out["doc_id"], out["start"], out["ids_crc32"])) == +pieces
    for _, own in out.sort_values("offset").groupby("sequence_id"):
        assert own["offset"].tolist() == (own["length"].cumsum() - own["length"]).tolist() and own["length"].sum() <= 4096
