"""Quality rules with host-level verdicts.

Every document is counted once (words, symbols, repeated lines, repeated
three-word windows) and held against the rules below. Failures are summed by
host; a host's rate is shrunk towards the rate of all hosts with a beta prior
fitted to the hosts by the method of moments, so that a host of two pages isn't
judged by them alone. A host is strict when it is worse than all hosts together: when
its posterior rate, less Z of its standard deviations, is above the rate of ODDS times
the odds of all. Documents of a strict host must pass every rule; elsewhere only the
base rules count. The verdict is joined back to the documents, so a document that
fails nothing is kept whatever its host.

Scale: one narrow Python pass in Arrow batches; the host sums are aggregated
before they are shuffled; the verdicts are broadcast when their counted rows are
few, else joined by host and salt, so that a host of a third of all rows is
spread.

Cases: a null text has no words and fails the base rules; null is a host of its
own; repeated rows are judged one by one; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridframe.llm.common import BROADCAST_ROWS, SPACES, WORD, cut, slices

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
SALTS = 64
#: How much worse than all a strict host is, as a ratio of odds, and how surely: in
#: standard deviations of its posterior, 95% on one side.
ODDS, Z = 2.0, 1.645
#: Documents that the prior counts for, at most.
MOST_WEIGHT = 100.0


def repeated_words(words: list[str], starts: np.ndarray) -> np.ndarray:
    """For texts whose words lie one after another: how many words of each are in
    a three-word window that its text has twice or more."""
    n, docs = len(words), len(starts) - 1
    doc = np.repeat(np.arange(docs), np.diff(starts))
    if n < 3:
        return np.zeros(docs, np.int64)
    codes, found = pd.factorize(np.array(words, dtype=object))
    codes = codes.astype(np.int64)
    pairs, n_pairs = pd.factorize(codes[:-1] * len(found) + codes[1:])
    own = doc[:-2] == doc[2:]
    triples, n_triples = pd.factorize((pairs[:-1] * np.int64(len(found)) + codes[2:])[own])
    windows, n_windows = pd.factorize(triples * np.int64(docs) + doc[:-2][own])
    at = np.flatnonzero(own)[np.bincount(windows, minlength=len(n_windows))[windows] > 1]
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[at + k] = True
    return np.bincount(doc[covered], minlength=docs)


def counts(texts: list[str | None]) -> dict[str, list[int]]:
    out: dict[str, list[int]] = {c: [] for c in COUNTS}
    words: list[str] = []
    starts = [0]
    for text in texts:
        text = text or ""
        own = WORD.findall(text)
        lines = [x for x in text.split("\n") if x.strip(SPACES)]
        words += own
        starts.append(len(words))
        out["n_words"].append(len(own))
        out["word_chars"].append(len(text) - sum(map(text.count, SPACES)))
        out["n_symbols"].append(sum(map(text.count, SYMBOLS)))
        out["n_lines"].append(len(lines))
        out["n_dup_lines"].append(len(lines) - len(set(lines)))
    out["n_repeat_words"] = repeated_words(words, np.array(starts)).tolist()
    return out


def counted(docs: DataFrame, keys: dict[str, Column], text: str = "text") -> DataFrame:
    """The keys and COUNTS of each row."""
    rows = docs.select(*[c.alias(k) for k, c in keys.items()], F.col(text).alias("__text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]] + [f"{c} long" for c in COUNTS])
    names = list(keys)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [batch.schema.field(k) for k in names]
            for part in slices(iter([batch]), [*names, "__text"], text="__text"):
                made = counts(part["__text"])
                columns = [pa.array(part[f.name], f.type) for f in kept] + [pa.array(made[c], pa.int64()) for c in COUNTS]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, *COUNTS])

    return rows.mapInArrow(count, schema)


def count_column(text: str) -> Column:
    """COUNTS of a text column, as a struct."""

    @F.pandas_udf(", ".join(f"{c} long" for c in COUNTS))
    def count(texts: pd.Series) -> pd.DataFrame:
        rows, parts, held = texts.tolist(), [], 0
        start = 0
        for end, t in enumerate(rows):  # a run of texts at a time, for bounded memory
            held += len(t or "")
            if held > 1_000_000:
                parts.append(pd.DataFrame(counts(rows[start : end + 1])))
                start, held = end + 1, 0
        parts.append(pd.DataFrame(counts(rows[start:]), columns=list(COUNTS), dtype="int64"))
        return pd.concat(parts, ignore_index=True)

    return count(F.col(text))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rule_failed() -> Column:
    """Any rule: the base rules; a symbol for every ten characters; a third of the
    lines repeated; words of less than two or more than twelve characters on average."""
    return (
        base_failed()
        | (10 * F.col("n_symbols") > F.col("word_chars"))
        | (3 * F.col("n_dup_lines") > F.col("n_lines"))
        | (F.col("word_chars") < 2 * F.col("n_words"))
        | (F.col("word_chars") > 12 * F.col("n_words"))
    )


def host_verdicts(judged: DataFrame, host: str) -> DataFrame:
    """host, n_docs, n_failed, host_rate (shrunk) and strict, a row for each host."""
    by_host = cut(judged.groupBy(host).agg(F.count("*").alias("n_docs"), F.sum(F.col("rule_failed").cast("long")).alias("n_failed")))
    # Moments of the hosts' rates, each weighted by its documents; exact sums, so that reruns agree.
    n, f, h, q, s = by_host.agg(
        F.sum("n_docs"), F.sum("n_failed"), F.count("*"),
        F.sum((F.col("n_failed") * F.col("n_failed") / F.col("n_docs")).cast("decimal(30,9)")),
        F.sum((F.col("n_docs") * F.col("n_docs")).cast("decimal(38,0)")),
    ).first()
    alpha, beta = beta_prior(n or 0, f or 0, h, float(q or 0), float(s or 0))
    shrunk = (F.col("n_failed") + F.lit(alpha)) / (F.col("n_docs") + F.lit(alpha + beta))
    rate, p = F.col("host_rate"), alpha / (alpha + beta)
    surely = rate - F.lit(Z) * F.sqrt(rate * (1 - rate) / (F.col("n_docs") + F.lit(alpha + beta + 1)))
    return by_host.withColumn("host_rate", shrunk).withColumn("strict", surely > F.lit(ODDS * p / (1 + (ODDS - 1) * p)))


def beta_prior(n: int, failed: int, hosts: int, squares: float, sizes: float) -> tuple[float, float]:
    """Alpha and beta of the hosts' rates: n documents on so many hosts, failed of
    them failing, the sum of failed^2/n over hosts and of n^2.

    The rates' variance above what chance alone gives (the one-way random-effects
    estimate) sets the prior's weight, between 1 and MOST_WEIGHT documents: also where
    hosts differ no more than by chance, one of many documents is judged by these."""
    if not n:
        return 0.5, 0.5
    p = failed / n
    if not 0 < p < 1:
        p = (failed + 0.5) / (n + 1)
    between = squares - failed * failed / n
    scale = n - sizes / n
    noise = (failed - squares) / max(1, n - hosts)
    extra = (between - (hosts - 1) * noise) / scale if hosts > 1 and scale > 0 else 0.0
    weight = min(MOST_WEIGHT, max(1.0, p * (1 - p) / extra - 1)) if extra > 0 else MOST_WEIGHT
    return p * weight, (1 - p) * weight


def host_rules(docs: DataFrame, host: Column, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id_col, host, COUNTS, base_failed, rule_failed, host_rate, strict and kept of each row."""
    judged = cut(counted(docs, {id_col: F.col(id_col), "host": host}, text).withColumns({"base_failed": base_failed(), "rule_failed": rule_failed()}))
    verdicts = host_verdicts(judged, "host").select(F.col("host").alias("__host"), "host_rate", "strict")
    if verdicts.count() <= BROADCAST_ROWS:
        verdicts, same = F.broadcast(verdicts), F.col("host").eqNullSafe(F.col("__host"))
    else:
        judged = judged.withColumn("__salt", F.pmod(F.xxhash64(id_col), F.lit(SALTS)))
        verdicts = verdicts.withColumn("__salted", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        same = F.col("host").eqNullSafe(F.col("__host")) & (F.col("__salt") == F.col("__salted"))
    joined = judged.join(verdicts, same, "left")
    kept = ~F.col("base_failed") & ~(F.col("strict") & F.col("rule_failed"))
    return joined.withColumn("kept", kept).drop("__host", "__salt", "__salted")


def kept_documents(docs: DataFrame, host: str, text: str = "text") -> DataFrame:
    """The rows of docs that their rules and their host's verdict keep, as they are.

    The texts are counted twice, for the hosts and then for each row, which moves
    no text between machines."""
    judged = counted(docs, {"__host": F.col(host)}, text).withColumn("rule_failed", rule_failed())
    verdicts = host_verdicts(judged, "__host").where("strict").select("__host")
    rows = docs.withColumn("__counts", count_column(text)).select(*docs.columns, "__counts.*") if not {*COUNTS} & {*docs.columns} else None
    if rows is None:  # columns of the counts' own names
        plain = docs.toDF(*[f"__own_{i}" for i in range(len(docs.columns))])
        at = {c: f"__own_{i}" for i, c in enumerate(docs.columns)}
        return kept_documents(plain, at[host], at[text]).toDF(*docs.columns)
    rows = rows.withColumns({"__base": base_failed(), "__any": rule_failed()}).drop(*COUNTS).where(~F.col("__base"))
    strict = verdicts.count()
    if strict:
        suspect = rows.where("__any")
        if strict <= BROADCAST_ROWS:
            suspect = suspect.join(F.broadcast(verdicts), F.col(host).eqNullSafe(F.col("__host")), "left_anti")
        else:
            salted = verdicts.withColumn("__salted", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            suspect = suspect.withColumn("__salt", F.pmod(F.xxhash64(text), F.lit(SALTS)))
            suspect = suspect.join(salted, F.col(host).eqNullSafe(F.col("__host")) & (F.col("__salt") == F.col("__salted")), "left_anti").drop("__salt")
        rows = rows.where(~F.col("__any")).unionByName(suspect)
    return rows.select(*docs.columns)
