"""SimHash near-duplicates found by covering locality-sensitive hashing.

Covering tables: every bit position gets a fixed non-zero vector of radius + 1
bits; table v keeps the positions whose vector has an odd product with v. The
vectors of at most ``radius`` differing positions cannot span the space, so some
non-zero v is orthogonal to all of them, and in that table both fingerprints have
the same key. All 2^(radius + 1) - 1 tables together miss no pair.

Fingerprints of one key are linked in numpy: small buckets by comparing all,
larger ones by a search that compares each reached one with those not reached
yet. Both are exact and give a spanning forest, never all pairs. Buckets beyond
HOT are divided by single-bit neighbours instead, which is exact too.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, components, spanning, table

SEED = 42
#: A bucket of more rows is searched instead of compared row by row at fixed distances.
SMALL = 16
#: Fingerprints of one key that a task gathers.
HOT = 100_000

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def majority(h: np.ndarray) -> int:
    """The 64 bits that are set in over half of the hashes; 0 for none."""
    octets = h.astype("<u8").view(np.uint8).reshape(-1, 8)
    out = 0
    for k in range(8):
        ones = np.bincount(octets[:, k], minlength=256) @ _BITS
        out |= int(np.packbits(ones * 2 > len(h), bitorder="little")[0]) << (8 * k)
    return out


def words_of(text: str | None) -> list[bytes]:
    """Lower-case (A-Z only) words between white space (space, U+0009 to U+000D)."""
    return (text or "").encode().lower().split()


def shingle_hashes(words: list[bytes], size: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of each run of ``size`` words, repeats included; of all words where they are fewer."""
    import xxhash

    if not words:
        return np.zeros(0, np.uint64)
    runs = zip(*(words[k:] for k in range(size)), strict=False) if len(words) >= size else [words]
    n = max(1, len(words) - size + 1)
    return np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, runs), repeat(seed)), np.uint64, n)


def fingerprint(text: str | None, size: int = 3) -> int:
    return majority(shingle_hashes(words_of(text), size))


def _signed(values) -> pa.Array:
    return pa.array(np.array(list(values), np.uint64).view(np.int64))


def fingerprints(docs: DataFrame, size: int = 3, *carried: str) -> DataFrame:
    """``docs(id, text)`` to (id, fp), with the ``carried`` columns behind."""

    def run(batches):
        for batch in batches:
            fps = _signed(fingerprint(t, size) for t in batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), fps, *batch.columns[2:]], ["id", "fp", *carried])

    rows = docs.select("id", "text", *carried)
    kinds = "".join(f", {c} {rows.schema[c].dataType.simpleString()}" for c in carried)
    return rows.mapInArrow(run, f"id long, fp long{kinds}")


def covering_masks(radius: int, bits: int = 64) -> list[int]:
    """The 2^(radius + 1) - 1 masks as signed 64-bit integers."""
    size = (1 << (radius + 1)) - 1
    vectors = [1 + ((k + 1) * 2654435761 >> 7) % size for k in range(bits)]
    masks = [sum(1 << k for k, m in enumerate(vectors) if bin(m & v).count("1") & 1) for v in range(1, size + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _near(x: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
    return np.bitwise_count(x ^ y) <= most


def bucket_links(keys: np.ndarray, fps: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) between fingerprints of runs of equal keys, enough to join all that differ in at most ``most`` bits."""
    bounds = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
    length = np.diff(bounds)
    size = np.repeat(length, length)
    a, b = [], []
    for step in range(1, SMALL):
        i = np.flatnonzero((size[:-step] <= SMALL) & (keys[:-step] == keys[step:])) if step < len(keys) else np.zeros(0, int)
        if not len(i):
            break
        i = i[_near(fps[i], fps[i + step], most)]
        a.append(fps[i])
        b.append(fps[i + step])
    for k in np.flatnonzero(length > SMALL):
        rest = fps[bounds[k] : bounds[k + 1]]
        while len(rest) > 1:
            reached, rest = [rest[0]], rest[1:]
            while reached and len(rest):
                at = reached.pop()
                near = _near(rest, at, most)
                new, rest = rest[near], rest[~near]
                reached.extend(new)
                a.append(np.full(len(new), at))
                b.append(new)
    none = np.zeros(0, fps.dtype)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def covering_links(points: DataFrame, radius: int, ws: Workspace, most: int = HOT) -> DataFrame:
    """Edges (a, b) that join the distinct fingerprints ``points(fp)`` within ``radius`` bits of each other.

    A key with more than ``most`` fingerprints is not gathered: its task passes
    them on one batch at a time, and they meet at the fingerprints one bit away,
    where at most 65 can. Two fingerprints within two bits share one of these.
    For a larger radius that would not hold, and a key is always gathered.
    """
    if radius > 2:
        most = 1 << 62

    def run(batches):
        # Parts of the key that the batches so far end with, and the key that is passed on.
        held, n, hot = [], 0, None
        for batch in batches:
            key, fp = (np.asarray(c) for c in batch.columns)
            own = np.searchsorted(key, hot, side="right") if hot is not None else 0
            if own:
                yield spread(fp[:own])
                key, fp = key[own:], fp[own:]
            if not len(key):
                continue
            last, hot = np.searchsorted(key, key[-1]), None
            if last:
                yield links([*held, (key[:last], fp[:last])])
            elif held and held[0][0][0] != key[0]:
                yield links(held)
            if last or held and held[0][0][0] != key[0]:
                held, n = [], 0
            held.append((key[last:], fp[last:]))
            n += len(key) - last
            if n > most:
                yield spread(np.concatenate([part for _, part in held]))
                held, n, hot = [], 0, key[-1]
        if held:
            yield links(held)

    def links(parts):
        key, fp = (np.concatenate(c) for c in zip(*parts, strict=True))
        bounds = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        large = np.repeat(np.diff(bounds) > most, np.diff(bounds))
        a, b = spanning(*(x.view(np.int64) for x in bucket_links(key[~large], fp[~large].view(np.uint64), radius)))
        many = fp[large]
        cols = [np.concatenate([a, many]), np.concatenate([b, many]), np.repeat([False, True], [len(a), len(many)])]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["a", "b", "hot"])

    def spread(fp):
        return pa.RecordBatch.from_arrays([pa.array(fp), pa.array(fp), pa.array(np.ones(len(fp), bool))], ["a", "b", "hot"])

    masks = F.array(*[F.lit(m).cast("long") for m in covering_masks(radius)])
    keyed = points.select("fp", F.explode(masks).alias("mask")).select(F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"), "fp")
    found = ws.keep(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long, hot boolean"), "met")
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << k if k < 63 else -(1 << 63)).cast("long") for k in range(64)])
    beside = found.filter("hot").select(F.col("a").alias("fp")).distinct().select("fp", F.explode(flips).alias("flip"))
    beside = beside.select(F.col("fp").bitwiseXOR(F.col("flip")).alias("key"), "fp").groupBy("key").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    close = beside.select(F.col("fps")[0].alias("a"), F.explode("fps").alias("b"))
    return found.filter("not hot").select("a", "b").unionByName(close).filter("a <> b").distinct()


def classes_of(rows: DataFrame, radius: int, ws: Workspace) -> DataFrame:
    """(fp, label) of the distinct fingerprints of ``rows(fp)``: equal labels where links reach."""
    points = rows.select("fp").distinct()
    labels = components(covering_links(points, radius, ws), ws).select(F.col("id").alias("fp"), F.col("component").alias("label"))
    return points.join(labels, "fp", "left").select("fp", F.coalesce("label", "fp").alias("label"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2) -> DataFrame:
    """(id, fp, component) for every row of ``docs``.

    Fingerprints within ``radius`` bits link; component is the smallest id that
    links reach. NULL and empty texts have fingerprint 0 and link like any other.
    Rows with a NULL id keep a row; their component is the smallest id reached,
    NULL where there is none. Repeated rows are kept each. Texts shorter than a
    shingle are one shingle, and texts of any length are read whole. Equal
    fingerprints are one vertex, so copies cost no pairs. An empty table gives an
    empty one; other columns are not read.
    """
    ws = Workspace(docs.sparkSession, "simhash")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = ws.keep(fingerprints(rows, words), "fingerprints")
    points = rows.groupBy("fp").agg(F.min("id").alias("least"))
    classes = points.join(classes_of(points, radius, ws), "fp")
    least = classes.groupBy("label").agg(F.min("least").alias("component"))
    classes = classes.join(least, "label").select("fp", "component")
    return rows.join(classes, "fp").select("id", "fp", "component")


def representatives(docs: DataFrame, key_col: str, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2) -> DataFrame:
    """(key): one of each group that links join, the row with the smallest id, then key; NULL ids come last.

    ``key_col`` tells rows apart (a digest of the row); rows of one key are one.
    An empty table gives an empty one.
    """
    ws = Workspace(docs.sparkSession, "simhash")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(key_col).alias("key"))
    rows = ws.keep(fingerprints(rows, words, "key"), "fingerprints")
    first = lambda c: F.min(c).alias("first")
    points = ws.keep(rows.groupBy("fp").agg(first(F.struct(F.col("id").isNull().alias("none"), "id", "key"))), "points")
    return points.join(classes_of(points, radius, ws), "fp").groupBy("label").agg(first("first")).select(F.col("first.key").alias(key_col))


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    out = simhash_components(table(spark, sf_dir, "documents"))
    return out.select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id")
    )
