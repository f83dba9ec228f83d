"""Toxicity by a subsequence-kernel support vector machine.

Two strings are compared by the subsequences of three and four characters that
they share, contiguous or not, every character skipped on either side costing a
factor GAP: an insult that is stretched, hyphenated or inflected still shares
most of its own. A sentence is seen through windows: its words, longer ones in
overlapping stretches, and runs of letters that stand alone (spelled-out words).
Every word is weighed, whatever it looks like; those that the kernel can't tell
apart, as they differ only in characters that no landmark has, are weighed once.

Landmarks are the strings that tell toxic from clean training documents best,
and common clean words; the Nystroem map K^(-1/2) k(window) turns the kernel into
a few coordinates, in which a linear machine is trained on labelled sentences.
A label marks a document, so the sentences of a toxic one are seen as a bag: in
turn the machine is trained and the sentence that it finds worst stands for its
document. A document's score is a logistic function of how much of it lies on the
toxic side, summed over its words, fitted on the training documents.

Scale: fitting sees a bounded sample (`limit` labelled documents), reduced on the
executors: string counts by aggregation, sentences to their landmark
similarities. Scoring is one pass over whole texts in Arrow batches; each worker
keeps the values of windows that it has seen. The model is a few kilobytes; a
worker folds its weights into a trie of the landmarks' strings (some megabytes at any
alphabet, as there are few landmarks), in which a word's value is a sum over its own
subsequences.

Cases: null and empty texts have no window and get the model's lowest score;
without labels of both kinds every score is the prior; repeated rows score
alike, as does a text in whatever batch it stands; an empty table gives no rows;
texts and words of any length are scored whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridframe.llm.common import cut, slices

GAP = np.float32(0.5)
WINDOW, STEP = 24, 12
EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”„‘’¿¡…–—"
STOP = re.compile(r"(?<=[.!?])\s")
TOXIC_LANDMARKS, CLEAN_LANDMARKS = 28, 4
GRAMS = (5, 6, 7)
KEPT_WINDOWS = 600_000
UNIT = 2.0**-20


def codes(strings: list[str]) -> np.ndarray:
    """Code points, a row for each of some strings of one length."""
    return np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(strings), -1)


def kernel(strings: list[str], landmarks: list[str]) -> np.ndarray:
    """The shared subsequences of three and four characters, weighted by gaps, of
    each string (at most WINDOW characters) with each landmark."""
    out = np.zeros((len(strings), len(landmarks)), np.float32)
    by_length: dict[int, list[int]] = {}
    for i, s in enumerate(strings):
        by_length.setdefault(len(s), []).append(i)
    by_width: dict[int, list[int]] = {}
    for i, s in enumerate(landmarks):
        by_width.setdefault(len(s), []).append(i)
    for n, rows in by_length.items():
        if n < 3:
            continue
        whole = codes([strings[i] for i in rows]).T.copy()
        for wide, marks in by_width.items():
            own, at_once = codes([landmarks[i] for i in marks]).T.copy(), max(1, 60_000 // (n * wide * len(marks)))
            for start in range(0, len(rows), at_once):
                some = rows[start : start + at_once]
                match = (whole[:, None, start : start + at_once, None] == own[None, :, None, :]).astype(np.float32)
                ends, total = match, np.zeros((len(some), len(marks)), np.float32)
                for order in (2, 3, 4):  # ends[i, j]: what ends in a match of places i and j
                    before_i, before_both = np.zeros_like(match), np.zeros_like(match)
                    for i in range(1, n):
                        before_i[i] = GAP * before_i[i - 1] + ends[i - 1]
                    for j in range(1, wide):
                        before_both[:, j] = GAP * before_both[:, j - 1] + before_i[:, j - 1]
                    ends = match * before_both
                    if order > 2:
                        total += ends.sum(axis=(0, 1))
                out[np.ix_(some, marks)] = total
    return out


class Folded:
    """A machine's weights on landmarks, as weights on the strings of three and four
    characters: the kernel is a sum over shared strings, so the weighted sum of a
    string's kernel values is one over its own subsequences. Weights are multiples
    of UNIT and decays are powers of two, so every sum is exact, in any order: a
    string's value doesn't depend on those beside it."""

    def __init__(self, landmarks: list[str], weights: np.ndarray):
        self.landmarks, self.weights = landmarks, weights.astype(np.float64)
        letters = sorted({ord(c) for m in landmarks for c in m})
        self.letters = len(letters) + 1  # 0: no landmark has it
        self.code = np.zeros(max(letters, default=0) + 2, np.int32)
        self.code[letters] = np.arange(1, self.letters)
        # The landmarks' strings as a trie: pairs, threes and fours have numbers from 1 on,
        # and a table leads from a number and a letter to the next number, 0 where no
        # landmark goes on so. The last table leads to weights.
        sums: dict[tuple[int, ...], float] = {}
        for m, weight in zip(landmarks, self.weights.tolist()):
            x = self.code[codes([m])[0]]
            for places, decays in places_of(len(m))[1:]:
                for string, decay in zip(x[places].T.tolist(), decays[:, 0].tolist()):
                    sums[tuple(string)] = sums.get(tuple(string), 0.0) + weight * decay
        pairs = {p: n for n, p in enumerate(sorted({s[:2] for s in sums}), 1)}
        threes = {t: n for n, t in enumerate(sorted({s[:3] for s in sums}), 1)}
        self.pairs = np.zeros(self.letters**2, np.int32)
        self.threes = np.zeros((len(pairs) + 1) * self.letters, np.int32)
        self.weight3, self.weight4 = np.zeros(len(threes) + 1), np.zeros((len(threes) + 1) * self.letters)
        for (a, b), n in pairs.items():
            self.pairs[a * self.letters + b] = n
        for t, n in threes.items():
            self.threes[pairs[t[:2]] * self.letters + t[2]] = n
        for string, total in sums.items():
            total = round(total / UNIT) * UNIT
            if len(string) == 3:
                self.weight3[threes[string]] = total
            else:
                self.weight4[threes[string[:3]] * self.letters + string[3]] = total

    def values(self, strings: list[str]) -> np.ndarray:
        """The weighted sum of each string's kernel values."""
        out = np.zeros(len(strings))
        by_length: dict[int, list[int]] = {}
        for i, s in enumerate(strings):
            by_length.setdefault(len(s), []).append(i)
        for n, rows in by_length.items():
            if n < 3:
                continue
            (pairs, _), (threes, decay3), (fours, decay4) = places_of(n)
            first_two, first_three = before(n)
            at_once = max(1, 400_000 // (len(decay3) + len(decay4)))
            for start in range(0, len(rows), at_once):
                some = rows[start : start + at_once]
                x = self.code[np.minimum(codes([strings[i] for i in some]).T, len(self.code) - 1)]
                letters = np.int32(self.letters)
                two = self.pairs[x[pairs[0]] * letters + x[pairs[1]]]
                three = self.threes[two[first_two] * letters + x[threes[2]]]
                total = (self.weight3[three] * decay3).sum(axis=0)
                if n > 3:
                    total += (self.weight4[three[first_three] * letters + x[fours[3]]] * decay4).sum(axis=0)
                out[some] = total
        return out


@lru_cache(maxsize=None)
def places_of(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For two, three and four: the ascending places within n, a row for each of
    them, and the decay of what they skip, as a column."""
    out = []
    for order in (2, 3, 4):
        made = np.array(list(combinations(range(n), order)), np.int64).reshape(-1, order).T
        out.append((made, float(GAP) ** (made[-1] - made[0] - order + 1)[:, None]))
    return out


@lru_cache(maxsize=None)
def before(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Which pair each three of places begins with, and which three each four."""
    (pairs, _), (threes, _), (fours, _) = places_of(n)
    number = {tuple(p): k for k, p in enumerate(pairs.T.tolist())}
    number3 = {tuple(p): k for k, p in enumerate(threes.T.tolist())}
    return np.array([number[tuple(p)] for p in threes[:2].T.tolist()], np.int64), np.array([number3[tuple(p)] for p in fours[:3].T.tolist()], np.int64)


class Bare(dict):
    """Brings strings that have one kernel with all landmarks to one form: what no
    landmark has becomes one character, and goes where it stands at the ends."""

    def __init__(self, landmarks: list[str]):
        super().__init__((ord(c), ord(c)) for m in landmarks for c in m)

    def __missing__(self, code: int) -> int:
        return 0

    def forms(self, strings: list[str]) -> list[str]:
        return [s.translate(self).strip("\0") for s in strings]


def tokens_of(text: str | None) -> list[str]:
    """All words of a text, lower-cased, and its spelled-out words."""
    tokens = (text or "").lower().split()
    return tokens + spelled(tokens)


def windows(token: str) -> list[str]:
    """A token without punctuation at its ends, and without any, between two spaces
    that mark where it begins and ends; long ones in overlapping stretches."""
    token = token.strip(EDGES)
    if len(token) < 3:
        return []
    if token.isalnum():
        if len(token) <= WINDOW - 2:
            return [f" {token} "]
        forms = [f" {token} "]
    else:
        forms = [f" {token} ", f" {''.join(filter(str.isalnum, token))} "]
    return [f[i : i + WINDOW] for f in forms if len(f) >= 5 for i in range(0, max(1, len(f) - STEP), STEP)]


def spelled(tokens: list[str]) -> list[str]:
    """Runs of three or more one-letter tokens, joined."""
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    if np.count_nonzero(sizes == 1) < 3:
        return []
    edge = np.flatnonzero(np.diff(np.r_[0, (sizes == 1).astype(np.int8), 0]))
    return ["".join(tokens[a:b]) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()) if b - a >= 3]


def sentence_texts(text: str | None) -> list[str]:
    """A text's sentences: up to a stop before white space, or the line's end."""
    return [s for line in (text or "").split("\n") for s in STOP.split(line) if s.strip()]


def all_windows(text: str | None) -> set[str]:
    """The windows of all words and spelled-out words of a text."""
    return {w for t in set(tokens_of(text)) for w in windows(t)}


@dataclass
class Model:
    landmarks: list[str] = field(default_factory=list)
    weights: np.ndarray | None = None  # on the kernel with the landmarks
    bias: float = 0.0
    slope: float = 0.0  # the logistic function's, and its value at no toxic word
    prior: float = 0.0

    def __post_init__(self) -> None:
        self.known: dict[str, float] = {}
        self.bare = Bare(self.landmarks)
        self.seen: dict[str, float] = {}
        self.folded: Folded | None = None

    def __getstate__(self) -> dict:  # what a worker makes for itself stays behind
        return {k: v for k, v in self.__dict__.items() if k not in ("known", "seen", "folded")} | {"known": {}, "seen": {}, "folded": None}

    def values(self, strings: list[str]) -> np.ndarray:
        forms, seen = self.bare.forms(strings), self.seen
        if len(seen) > KEPT_WINDOWS:
            seen.clear()
        self.folded = self.folded or Folded(self.landmarks, self.weights)
        new = [f for f in dict.fromkeys(forms) if f not in seen]
        seen.update(zip(new, (self.folded.values(new) + self.bias).tolist()))
        return np.array([seen[f] for f in forms])

    def look_up(self, tokens: set[str]) -> dict[str, float]:
        known = self.known
        if len(known) > KEPT_WINDOWS:
            known.clear()
        new = [t for t in tokens if t not in known]
        parts = [(t, w) for t in new for w in windows(t)]
        known.update(dict.fromkeys(new, 0.0))
        if parts:
            strings = list({w for _, w in parts})
            value = dict(zip(strings, self.values(strings).tolist()))
            for t, w in parts:
                known[t] = max(known[t], value[w])
        return known

    def amounts(self, texts: list[str | None]) -> np.ndarray:
        """How much of each text lies on the toxic side: the logarithm of one and its
        words' values above zero."""
        split = [tokens_of(t) for t in texts]
        known = self.look_up({t for s in split for t in s})
        return np.log1p([math.fsum(map(known.__getitem__, s)) for s in split])

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """The logistic function of each text's amount."""
        amounts = np.zeros(len(texts)) if self.weights is None else self.amounts(texts)
        return 1 / (1 + np.exp(-(self.prior + self.slope * amounts)))


def string_counts(sample: DataFrame) -> DataFrame:
    """string, bad and good: how often it occurs among the distinct windows of toxic
    and clean documents, for windows and their substrings."""

    def occurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, ["text", "label"]):
            bad, good = Counter(), Counter()
            for text, label in zip(part["text"], part["label"]):
                (bad if label else good).update(all_windows(text))
            yield count_batch(bad, good)

    def substrings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bad, good = Counter(), Counter()
            for w, b, g in zip(*(c.to_pylist() for c in batch.columns)):
                for s in {w, *(w[i : i + n] for n in GRAMS for i in range(len(w) - n + 1))}:
                    if b:
                        bad[s] += b
                    if g:
                        good[s] += g
            yield count_batch(bad, good)

    def summed(counts: DataFrame) -> DataFrame:
        return counts.groupBy("string").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))

    kinds = "string string, bad long, good long"
    return summed(summed(sample.select("text", "label").mapInArrow(occurring, kinds)).mapInArrow(substrings, kinds))


def count_batch(bad: Counter, good: Counter) -> pa.RecordBatch:
    strings = list(bad.keys() | good.keys())
    return pa.RecordBatch.from_arrays([pa.array(strings, pa.string()), pa.array([bad[s] for s in strings], pa.int64()), pa.array([good[s] for s in strings], pa.int64())], names=["string", "bad", "good"])


def choose_landmarks(counted: DataFrame, n_bad: int, n_good: int) -> list[str]:
    """Greedily by how well a string tells toxic documents, none too like another;
    then the commonest strings of clean ones. Candidates come in order, a partition
    at a time, until enough are chosen."""
    rate_bad, rate_good = (F.col("bad") + 0.5) / (n_bad + 1), (F.col("good") + 0.5) / (n_good + 1)
    telling = F.round(F.col("bad") * F.log(rate_bad / rate_good), 6)
    toxic = counted.where((F.col("bad") >= 3) & (rate_bad > 4 * rate_good)).orderBy(telling.desc(), F.length("string").desc(), "string")
    common = counted.where((F.length("string") >= 4) & (F.col("bad") * n_good <= F.col("good") * n_bad * 1.2)).orderBy(F.col("good").desc(), "string")
    chosen: list[str] = []
    own: list[float] = []
    for candidates, most in ((toxic, TOXIC_LANDMARKS), (common, TOXIC_LANDMARKS + CLEAN_LANDMARKS)):
        for (s,) in candidates.select("string").toLocalIterator():
            if len(chosen) >= most:
                break
            if any(s in c or c in s for c in chosen):
                continue
            k = kernel([s], [s, *chosen])[0]
            if k[0] > 0 and (k[1:] <= 0.55 * np.sqrt(k[0] * np.array(own))).all():
                chosen.append(s)
                own.append(float(k[0]))
        if not chosen:
            return []
    return chosen


def suspects(sample: DataFrame, landmarks: list[str]) -> DataFrame:
    """doc, label and form: of every sentence of a document, the window that is most
    like a toxic landmark, once for each document."""
    own = kernel(landmarks, landmarks).diagonal()
    toxic = min(TOXIC_LANDMARKS, len(landmarks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bare = Bare(landmarks)
        for part in slices(batches, ["doc", "text", "label"], 1_000_000):
            found = [(i, tokens_of(line)) for i, t in enumerate(part["text"]) for line in sentence_texts(t)]
            strings = list({w for _, tokens in found for t in tokens for w in windows(t)})
            forms = dict(zip(strings, bare.forms(strings)))
            single = list(dict.fromkeys(forms.values()))
            like = dict(zip(single, (kernel(single, landmarks) / own)[:, :toxic].max(axis=1).tolist() if single else []))
            rows = dict.fromkeys((i, max((like[f], f) for f in mine)[1]) for i, tokens in found if (mine := [forms[w] for t in tokens for w in windows(t)]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([part[c][i] for i, _ in rows], k) for c, k in (("doc", pa.int64()), ("label", pa.int32()))] + [pa.array([f for _, f in rows], pa.string())], names=["doc", "label", "form"])

    return sample.select("doc", "text", "label").mapInArrow(run, "doc long, label int, form string").distinct()


def vectors_of(forms: DataFrame, landmarks: list[str]) -> DataFrame:
    """form and k (kernel values with the landmarks), once for each form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = kernel(batch.column("form").to_pylist(), landmarks)
            yield pa.RecordBatch.from_arrays([batch.column("form"), pa.ListArray.from_arrays(pa.array(np.arange(0, k.size + 1, k.shape[1]), pa.int32()), pa.array(k.reshape(-1)))], names=["form", "k"])

    return forms.select("form").distinct().mapInArrow(run, "form string, k array<float>")


def linear_machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-4, rounds: int = 30) -> np.ndarray:
    """Weights (the last a bias) of the squared-hinge machine, by Newton's method."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    ridge = penalty * weight.sum() * np.eye(x.shape[1])
    ridge[-1, -1] *= 1e-3
    for _ in range(rounds):
        inside = 1 - y * (x @ w) > 0
        a = x[inside] * weight[inside][:, None]
        new = np.linalg.solve(a.T @ x[inside] + ridge, a.T @ y[inside])
        if np.allclose(new, w, atol=1e-8):
            break
        w = new
    return w


def variants(string: str) -> list[str]:
    """Spellings with a character put in, one doubled, and all set apart."""
    body = string.strip(" ")
    inner = range(1, len(body))
    made = [body[:i] + c + body[i:] for i in inner for c in "-x"] + [body[:i] + body[i - 1 :] for i in inner] + [c.join(body) for c in ".-"]
    return [string.replace(body, m)[:WINDOW] for m in made]


def fit(sample: DataFrame) -> Model:
    """A model of sample(doc, text, label), at most some ten thousand rows."""
    sizes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n_bad, n_good = sizes.get(1, 0), sizes.get(0, 0)
    prior = float(np.log((n_bad + 0.5) / (n_good + 0.5))) if n_bad + n_good else -2.0
    landmarks = choose_landmarks(cut(string_counts(sample)), n_bad, n_good) if n_bad and n_good else []
    if not landmarks:
        return Model(prior=prior)
    pairs = cut(suspects(sample, landmarks))
    rows = pairs.toArrow().sort_by([("doc", "ascending"), ("form", "ascending")])
    doc, bad = rows["doc"].to_numpy(), rows["label"].to_numpy() == 1
    if bad.all() or not bad.any():
        return Model(prior=prior)
    known = vectors_of(pairs, landmarks).toArrow().sort_by("form")
    at = pc.index_in(rows["form"], value_set=known["form"]).to_numpy()
    k = known["k"].combine_chunks().flatten().to_numpy().reshape(known.num_rows, -1).astype(np.float64)
    alike = kernel(landmarks, landmarks).astype(np.float64)
    values, vectors = np.linalg.eigh(alike)
    keep = values > 1e-3 * values.max()
    project = vectors[:, keep] / np.sqrt(values[keep])
    x = k @ project  # a row for each form: documents share them
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    toxic = landmarks[: min(TOXIC_LANDMARKS, len(landmarks))]
    score = ((k / alike.diagonal())[:, : len(toxic)].max(axis=1) * 2 - 1.5)[at]
    spoilt = kernel([v for m in toxic for v in variants(m)], landmarks).astype(np.float64) @ project
    for _ in range(3):
        worst_of_doc = score >= np.repeat(np.maximum.reduceat(score, first), np.diff(np.r_[first, len(doc)]))
        use = worst_of_doc | (score > np.where(bad, 0, -1))  # clean ones below -1 are right already and have no loss
        y = np.where(bad, 1.0, -1.0)[use]
        # Both classes weigh alike; a sentence that only its document's label speaks for weighs little.
        trust = np.where(score[use] > 0, 1.0, 0.1)
        weight = np.where(y > 0, trust / max(1e-9, trust[y > 0].sum()), 1 / max(1, (y < 0).sum()))
        w = linear_machine(np.r_[x[at[use]], spoilt], np.r_[y, np.ones(len(spoilt))], np.r_[weight, np.full(len(spoilt), 0.1 / max(1, len(spoilt)))])
        score = (x @ w[:-1] + w[-1])[at]
    model = Model(landmarks, (project @ w[:-1]).astype(np.float32), float(w[-1]), prior=prior)
    seen = amount_rows(sample, model).toArrow().sort_by("doc")
    design, label = np.c_[seen["amount"].to_numpy(), np.ones(seen.num_rows)], (seen["label"].to_numpy() == 1).astype(float)
    c = np.array([0.0, prior])
    for _ in range(50):  # a ridge logistic fit by Newton's method
        p = 1 / (1 + np.exp(-design @ c))
        gradient = design.T @ (label - p) - 1e-2 * c * np.array([1, 0])
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 1e-2 * np.diag([1, 0.01])
        c = c + np.linalg.solve(hessian, gradient)
    model.slope, model.prior = map(float, c)
    return model


def amount_rows(sample: DataFrame, model: Model) -> DataFrame:
    """doc, label and amount of each document of the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = worker_model(model)
        for part in slices(batches, ["doc", "text", "label"]):
            yield pa.RecordBatch.from_arrays([pa.array(part["doc"], pa.int64()), pa.array(part["label"], pa.int32()), pa.array(own.amounts(part["text"]))], names=["doc", "label", "amount"])

    return sample.select("doc", "text", "label").mapInArrow(run, "doc long, label int, amount double")


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id_col and score of each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = worker_model(model)
        for part in slices(batches, ["__id", "__text"], text="__text"):
            yield pa.RecordBatch.from_arrays([pa.array(part["__id"], pa.int64()), pa.array(own.scores(part["__text"]), pa.float64())], names=["__id", "score"])

    named = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text).alias("__text"))
    return named.mapInArrow(run, "__id long, score double").withColumnRenamed("__id", id_col)


_models: dict[tuple, Model] = {}


def worker_model(model: Model) -> Model:
    """This process's copy of a model, with the windows that it has seen."""
    key = (tuple(model.landmarks), None if model.weights is None else model.weights.tobytes(), model.bias, model.slope, model.prior)
    if key not in _models:
        _models.clear()
        _models[key] = model
    return _models[key]


def sample_texts(docs: DataFrame, training: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, text and label of the training rows (few: they are broadcast)."""
    named = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text).alias("text"))
    return cut(named.join(F.broadcast(training), named["doc"] == training["__doc"]).select("doc", "text", F.col("__label").alias("label")))
