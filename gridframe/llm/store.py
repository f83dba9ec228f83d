"""A content-addressed store of token ids.

Each document's ids are cut into chunks where a rolling hash of the last ids is
zero in its low bits, so that equal passages give equal chunks wherever they
stand. A chunk is named by the digest of its bytes and is stored once; a recipe
lists a document's chunks; manifests hold Merkle roots over the recipes.

Files under `path`, all written and read by Spark:
  chunks/    hi, lo (the digest's halves), ids (little-endian, `width` bytes each),
             holders (how many tasks sent it)
  recipes/   part, pos, doc_id, start (within the part), n_tokens, chunks
             (digests, 16 bytes each), root (of all that and the chunks' Merkle
             root); parts and positions ascend by doc_id
  manifest/  part, before (ids of all parts before it), n_docs, n_tokens, root
             (over the recipes' roots); part -1 is the corpus, its root over the
             parts' rows

Scale: texts are tokenised once; what that gives is staged in the shared folder,
since two tables are made from it. A task drops chunks it has already sent, and
the rest are aggregated by digest. Recipes are range-partitioned by doc_id and
numbered within their part; the parts' totals give the starts. Reading back
checks every chunk's bytes against its name where it is stored and sends on only
its CRC, which is shifted by the bytes that follow it and combined by exclusive
or: documents are verified without moving their ids again. Every recipe read is
hashed anew and held against its root, and the roots against the manifest; what
differs raises. Chunks with most holders, HOT at most, are joined under salts, so
that a chunk which a third of all documents share is no hot key.

Cases: a null or empty text is the end id alone; repeated rows have recipes of
their own and share chunks; texts of any length are cut into as many chunks as
they need; an empty table gives empty folders and no rows; further columns are
not read; a null id is kept and sorts first. An id that `width` bytes can't hold
raises.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridframe.llm.common import remove_path, slices, spread_join, staged_path
from gridframe.llm.tokens import encoder

MIN_IDS, MASK, MAX_IDS, REACH = 64, 0x1FF, 4096, 8
DIGEST = 16
HOT, HOT_HOLDERS = 1000, 16


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=DIGEST).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """Pairs are hashed upwards; an odd last node goes up as it is."""
    level = leaves or [digest(b"")]
    while len(level) > 1:
        level = [digest(b"".join(level[i : i + 2])) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def recipe_root(doc_id: int | None, start: int, n_tokens: int, chunks: bytes) -> bytes:
    """A document's root: of its place, its length and the Merkle root of its chunks."""
    return digest(struct.pack("<?qqq", doc_id is None, doc_id or 0, start, n_tokens) + merkle_root([chunks[i : i + DIGEST] for i in range(0, len(chunks), DIGEST)]))


def corpus_root(parts: list[tuple[int, int, int, int, bytes]]) -> bytes:
    """The root over the manifest's rows (part, before, n_docs, n_tokens, root)."""
    return merkle_root([digest(struct.pack("<qqqq", *p[:4]) + p[4]) for p in parts])


def cuts(ids: np.ndarray) -> list[int]:
    """Where chunks end: after an id at which the gear hash of the REACH ids up to
    it has zero low bits, but not within MIN_IDS, and after MAX_IDS at the latest."""
    gear = ids.astype(np.uint32) * np.uint32(0x9E3779B1)
    gear ^= gear >> np.uint32(15)
    gear *= np.uint32(0x85EBCA77)
    rolling, k = gear, 1
    while k < min(REACH, len(gear)):  # sums of 1, 2, 4 ... ids; REACH is a power of two
        rolling[k:] += rolling[:-k] << np.uint32(2 * k)
        k *= 2
    ends, last = [], 0
    for at in (np.flatnonzero(rolling & np.uint32(MASK << 16) == 0) + 1).tolist():
        while at - last > MAX_IDS:
            last += MAX_IDS
            ends.append(last)
        if at - last >= MIN_IDS:
            ends.append(at)
            last = at
    while len(ids) - last > MAX_IDS:
        last += MAX_IDS
        ends.append(last)
    return [*ends, len(ids)] if last < len(ids) else ends


def encoded(docs: DataFrame, tokenizer: str, end_id: int, width: int, id_col: str, text: str) -> DataFrame:
    """doc_id, n_tokens, chunks (digests), sizes (ids of each chunk) and ids of each row."""
    end = np.array([end_id], "<u4").tobytes()
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("chunks", pa.binary()), ("sizes", pa.binary()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for part in slices(batches, ["__id", "__text"], 4_000_000, "__text"):
            rows = []
            for i, made in zip(part["__id"], encode.ids([t or "" for t in part["__text"]])):
                ids = np.frombuffer(made + end, "<u4")
                if width < 4 and int(ids.max()) >> (8 * width):
                    raise ValueError(f"the id {int(ids.max())} does not fit in {width} bytes")
                raw = ids.astype(f"<u{width}").tobytes()
                ends = cuts(ids)
                starts = [0, *ends[:-1]]
                names = b"".join(digest(raw[width * a : width * b]) for a, b in zip(starts, ends))
                rows.append((i, len(ids), names, np.diff([0, *ends]).astype("<u2").tobytes(), raw))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    named = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text).alias("__text"))
    return named.mapInArrow(run, "doc_id long, n_tokens long, chunks binary, sizes binary, ids binary")


def unique_chunks(staged: DataFrame, width: int) -> DataFrame:
    """hi, lo, ids and holders of every chunk, once."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()
        for batch in batches:
            names, bodies, held = [], [], 0
            for chunks, sizes, ids in zip(batch.column("chunks").to_pylist(), batch.column("sizes").to_pylist(), batch.column("ids").to_pylist()):
                at = 0
                for k, n in enumerate(np.frombuffer(sizes, "<u2").tolist()):
                    name, body = chunks[DIGEST * k : DIGEST * (k + 1)], ids[at : at + width * n]
                    at += width * n
                    if name not in sent:
                        sent.add(name)
                        names.append(name)
                        bodies.append(body)
                        held += len(body)
                if held > 4_000_000:
                    yield chunk_batch(names, bodies)
                    names, bodies, held = [], [], 0
            if len(sent) > 200_000:
                sent.clear()
            if names:
                yield chunk_batch(names, bodies)

    rows = staged.select("chunks", "sizes", "ids").mapInArrow(spread, "hi long, lo long, ids binary")
    rows = rows.repartition("hi", "lo")  # a task has sent each chunk once: nothing to aggregate, and sort, before
    return rows.groupBy("hi", "lo").agg(F.first("ids").alias("ids"), F.count("*").alias("holders"))


def chunk_batch(names: list[bytes], bodies: list[bytes]) -> pa.RecordBatch:
    halves = np.frombuffer(b"".join(names), "<i8").reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(bodies, pa.binary())], names=["hi", "lo", "ids"])


def recipes(staged: DataFrame) -> DataFrame:
    """The recipes in ascending doc_id, numbered and started within their part."""
    schema = pa.schema([("part", pa.int32()), ("pos", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("chunks", pa.binary()), ("root", pa.binary())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pos = start = 0
        for batch in batches:
            n = batch.column("n_tokens").to_numpy()
            ends = start + np.cumsum(n)
            chunks = batch.column("chunks").to_pylist()
            roots = list(map(recipe_root, batch.column("doc_id").to_pylist(), (ends - n).tolist(), n.tolist(), chunks))
            columns = [batch.column("part"), pa.array(pos + np.arange(len(n))), batch.column("doc_id"), pa.array(ends - n), batch.column("n_tokens"), batch.column("chunks"), pa.array(roots, pa.binary())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)
            pos, start = pos + len(n), int(ends[-1]) if len(n) else start

    ranged = staged.select("doc_id", "n_tokens", "chunks").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "chunks")
    return ranged.select(F.spark_partition_id().alias("part"), "*").mapInArrow(number, "part int, pos long, doc_id long, start long, n_tokens long, chunks binary, root binary")


def part_manifests(written: DataFrame) -> DataFrame:
    """part, n_docs, n_tokens and root: over the roots of blocks of 4096 recipes, so
    that no task holds a part's roots at once."""

    def root_of(column: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                roots = [merkle_root([x["root"] for x in sorted(rows, key=lambda x: x["at"])]) for rows in batch.column(column).to_pylist()]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in batch.schema.names if c != column], pa.array(roots, pa.binary())], names=[*[c for c in batch.schema.names if c != column], "root"])

        return run

    blocks = written.groupBy("part", F.floor(F.col("pos") / 4096).alias("block")).agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.collect_list(F.struct(F.col("pos").alias("at"), "root")).alias("roots"))
    blocks = blocks.mapInArrow(root_of("roots"), "part int, block long, n_docs long, n_tokens long, root binary")
    parts = blocks.groupBy("part").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.collect_list(F.struct(F.col("block").alias("at"), "root")).alias("roots"))
    return parts.mapInArrow(root_of("roots"), "part int, n_docs long, n_tokens long, root binary")


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text: str = "text", width: int = 2) -> None:
    """Write the store of docs' ids to a new folder. width: bytes of an id; 2 holds
    vocabularies of up to 65,536 ids."""
    spark = docs.sparkSession
    staging = staged_path(spark, "encoded")
    encoded(docs, tokenizer, end_id, width, id_col, text).write.option("compression", "zstd").parquet(staging)
    staged = spark.read.parquet(staging)
    unique_chunks(staged, width).write.option("compression", "zstd").parquet(f"{path}/chunks")
    recipes(staged).write.option("compression", "zstd").parquet(f"{path}/recipes")
    remove_path(spark, staging)
    spark.createDataFrame(manifest_rows(spark, path), "part int, before long, n_docs long, n_tokens long, root binary").coalesce(1).write.parquet(f"{path}/manifest")


def manifest_rows(spark: SparkSession, path: str) -> list[tuple[int, int, int, int, bytes]]:
    """The manifest of the recipes as they are: part, before, n_docs, n_tokens and root."""
    rows, before = [], 0
    for r in part_manifests(spark.read.parquet(f"{path}/recipes")).orderBy("part").collect():  # a row for each file of recipes
        rows.append((r["part"], before, r["n_docs"], r["n_tokens"], bytes(r["root"])))
        before += r["n_tokens"]
    return [*rows, (-1, 0, sum(r[2] for r in rows), before, corpus_root(rows))]


def check_manifest(spark: SparkSession, path: str) -> None:
    """Raises if the recipes' roots don't give the manifest."""
    kept = [(r["part"], r["before"], r["n_docs"], r["n_tokens"], bytes(r["root"])) for r in spark.read.parquet(f"{path}/manifest").collect()]
    if sorted(kept) != sorted(manifest_rows(spark, path)):
        raise ValueError("the recipes do not give the roots in the manifest")


@lru_cache(maxsize=1)
def zero_tables() -> np.ndarray:
    """[k, i, b]: what byte i = b of a CRC becomes when 2^k zero bytes follow it."""
    single = np.zeros((4, 256), np.uint32)
    crc = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        crc = np.where(crc & 1, (crc >> 1) ^ np.uint32(0xEDB88320), crc >> 1).astype(np.uint32)
    b = np.arange(256, dtype=np.uint32)
    for i in range(4):
        x = b << np.uint32(8 * i)
        single[i] = crc[x & 0xFF] ^ (x >> np.uint32(8))
    tables = [single]
    for _ in range(47):
        t = tables[-1]
        tables.append(np.stack([shifted_once(t, t[i]) for i in range(4)]))
    return np.stack(tables)


def shifted_once(t: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return t[0][crc & 0xFF] ^ t[1][(crc >> 8) & 0xFF] ^ t[2][(crc >> 16) & 0xFF] ^ t[3][crc >> 24]


def shift_crc(crc: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Each CRC's part in the CRC of a text in which so many bytes follow it."""
    crc, tables = crc.astype(np.uint32), zero_tables()
    for k in range(int(following.max()).bit_length() if len(following) else 0):
        at = np.flatnonzero((following >> k) & 1)
        crc[at] = shifted_once(tables[k], crc[at])
    return crc


def check_names(batch: pa.RecordBatch) -> list[bytes]:
    """The bodies of some chunks, if they match their names."""
    bodies = batch.column("ids").to_pylist()
    names = np.stack([batch.column("hi").to_numpy(), batch.column("lo").to_numpy()], 1).astype("<i8").tobytes()
    if names != b"".join(map(digest, bodies)):
        raise ValueError("a stored chunk's bytes do not match its name")
    return bodies


def chunk_sums(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """hi, lo, crc (of the chunk's ids as unsigned 32-bit integers) and n of every
    stored chunk, whose bytes are held against its name."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = check_names(batch)
            crcs = [zlib.crc32(np.frombuffer(b, f"<u{width}").astype("<u4").tobytes()) for b in bodies]
            yield pa.RecordBatch.from_arrays([batch.column("hi"), batch.column("lo"), pa.array(crcs, pa.int64()), pa.array([len(b) // width for b in bodies], pa.int64())], names=["hi", "lo", "crc", "n"])

    return spark.read.parquet(f"{path}/chunks").select("hi", "lo", "ids").mapInArrow(check, "hi long, lo long, crc long, n long")


def references(recipe: DataFrame) -> DataFrame:
    """part, pos, seq, hi and lo of each chunk of each recipe, which is held against its root."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunks = batch.column("chunks").to_pylist()
            roots = map(recipe_root, *(batch.column(c).to_pylist() for c in ("doc_id", "start", "n_tokens")), chunks)
            if list(roots) != batch.column("root").to_pylist():
                raise ValueError("a recipe does not give its root")
            n = np.array([len(c) // DIGEST for c in chunks])
            halves = np.frombuffer(b"".join(chunks), "<i8").reshape(-1, 2)
            seq = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            part, pos = (np.repeat(batch.column(c).to_numpy(), n) for c in ("part", "pos"))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (part, pos, seq, halves[:, 0], halves[:, 1])], names=["part", "pos", "seq", "hi", "lo"])

    return recipe.select("part", "pos", "doc_id", "start", "n_tokens", "chunks", "root").mapInArrow(spread, "part int, pos long, seq long, hi long, lo long")


def with_chunks(found: DataFrame, stored: DataFrame, holders: DataFrame) -> DataFrame:
    """found(part, pos, seq, hi, lo) with what stored(hi, lo, ...) has, or nulls. The
    chunks of most holders (hi, lo, holders), HOT at most, are spread over salts."""
    most = holders.where(F.col("holders") >= HOT_HOLDERS).orderBy(F.col("holders").desc(), "hi", "lo").limit(HOT).select("hi").collect()
    return spread_join(found, stored, ["hi", "lo"], sorted({r["hi"] for r in most}), ["part", "pos", "seq"], "left")


def read_sums(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files, which
    are verified on the way."""
    check_manifest(spark, path)
    recipe = spark.read.parquet(f"{path}/recipes")
    found = with_chunks(references(recipe), chunk_sums(spark, path, width), spark.read.parquet(f"{path}/chunks"))
    after = Window.partitionBy("part", "pos").orderBy(F.col("seq").desc()).rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("following", F.coalesce(F.sum("n").over(after), F.lit(0)) * 4)

    def shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.column("crc").null_count:
                raise ValueError("a recipe names a chunk that is not stored")
            moved = shift_crc(batch.column("crc").to_numpy(), batch.column("following").to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("pos"), batch.column("n"), pa.array(moved.astype(np.int64))], names=["part", "pos", "n", "crc"])

    sums = found.select("part", "pos", "n", "crc", "following").mapInArrow(shift, "part int, pos long, n long, crc long")
    sums = sums.groupBy("part", "pos").agg(F.sum("n").alias("found_tokens"), F.bit_xor("crc").alias("ids_crc32"))
    rows = placed_recipes(spark, path).join(sums, ["part", "pos"])
    same = F.when(F.col("found_tokens") == F.col("n_tokens"), F.col("n_tokens")).otherwise(F.raise_error(F.lit("a document's chunks do not have its length")))
    return rows.select("doc_id", "start", same.alias("n_tokens"), "ids_crc32")


def placed_recipes(spark: SparkSession, path: str) -> DataFrame:
    """part, pos, doc_id, start (in the corpus) and n_tokens of every recipe."""
    manifest = spark.read.parquet(f"{path}/manifest").where("part >= 0").select("part", "before")
    recipe = spark.read.parquet(f"{path}/recipes")
    return recipe.join(manifest, "part").select("part", "pos", "doc_id", (F.col("before") + F.col("start")).alias("start"), "n_tokens")


def read_ids(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """doc_id, start and ids (little-endian unsigned 32-bit) of every document; the
    recipes are verified on the way, the chunks by their names."""
    check_manifest(spark, path)
    stored = spark.read.parquet(f"{path}/chunks")

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            check_names(batch)
            yield batch.select(["hi", "lo", "ids"])

    bodies = stored.select("hi", "lo", "ids").mapInArrow(named, "hi long, lo long, ids binary")
    found = with_chunks(references(spark.read.parquet(f"{path}/recipes")), bodies, stored)
    found = found.groupBy("part", "pos").agg(F.sort_array(F.collect_list(F.struct("seq", "ids"))).alias("chunks"))

    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunks = batch.column("chunks").to_pylist()
            if any(x["ids"] is None for c in chunks for x in c):
                raise ValueError("a recipe names a chunk that is not stored")
            ids = [np.frombuffer(b"".join(x["ids"] for x in c), f"<u{width}").astype("<u4").tobytes() for c in chunks]
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("pos"), pa.array(ids, pa.binary())], names=["part", "pos", "ids"])

    joined = found.mapInArrow(join_up, "part int, pos long, ids binary")
    return placed_recipes(spark, path).join(joined, ["part", "pos"]).select("doc_id", "start", "ids")


def verify(spark: SparkSession, path: str, width: int = 2) -> bool:
    """Whether chunks, recipes and manifest are as they were written."""
    try:
        read_sums(spark, path, width).agg(F.sum("ids_crc32")).collect()
    except (ValueError, PySparkException):
        return False
    return True
