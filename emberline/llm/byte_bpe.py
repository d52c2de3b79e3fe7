"""Byte-level BPE: texts to ids of a rank file, and ids back to bytes.

A long text is cut in chunks that overlap, and the chunks are split into pieces
by the vocabulary's pattern in parallel. A match depends only on what follows its
start, so two scans that share one boundary agree from there on: neighbouring
chunks are stitched at the first boundary in their overlap that both have. A
chunk's matches count only where no character beyond its end could change them.
Each chunk then encodes the pieces between its two stitches, wherever it lies. A
text in which some overlap holds no common boundary (a run of one kind of
character longer than the overlap) is split as a whole instead.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from itertools import accumulate, chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Workspace, table
from .token_counts import BeforeSpaces, batches_by_bytes

#: Fixed value: the pattern whose pieces always begin at a lone space.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of a chunk, and what it sees of the next one.
CHUNK, OVERLAP = 1 << 16, 1 << 10
#: A match that starts closer to the end of a chunk than the longest fixed alternative may be another one ('re).
AHEAD = 3
#: Pieces in each of the two generations that a worker remembers; longer pieces than LONG are encoded each time.
MEMORY, LONG = 200_000, 64
#: Bytes of text that are encoded at once.
BATCH = 4_000_000

_workers: dict = {}


class Memory(dict):
    """Values by key, made where missing; a full generation is set aside and what is used again comes back from there."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= LONG:
            self[key] = value
        return value

    def trim(self) -> None:
        if len(self) > MEMORY:
            self.old = dict(self)
            self.clear()


class Codec:
    """Pieces, ids and bytes of one vocabulary; one for each rank file, pattern and worker."""

    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        # Its pattern takes the whole input, so it merges one piece at a time.
        merge = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.pieces = regex.compile(pattern).findall
        #: The ids of a stretch of whole pieces as bytes.
        self.memory = Memory(lambda stretch: array("i", chain.from_iterable(map(merge, self.pieces(stretch)))).tobytes())
        self.merged = Memory(lambda piece: array("i", merge(piece)).tobytes())
        self.spaced = pattern == BYTE_LEVEL
        tokens = [None] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.tokens = pa.array(tokens, pa.binary())

    @classmethod
    def of(cls, path: str, pattern: str) -> Codec:
        if (path, pattern) not in _workers:
            _workers[path, pattern] = cls(path, pattern)
        return _workers[path, pattern]

    def encode(self, pieces) -> bytes:
        return b"".join(map(self.merged.__getitem__, pieces))

    def texts(self, texts: pa.Array) -> pa.ListArray:
        """Ids of whole texts without NULLs: each text is a row of stretches, of which the distinct ones are encoded."""
        stretches = stretches_of(texts) if self.spaced else pa.ListArray.from_arrays(np.arange(len(texts) + 1, dtype=np.int32), texts)
        at = stretches.offsets.to_numpy().astype(np.int64)
        coded = stretches.values.slice(at[0], at[-1] - at[0]).dictionary_encode()
        known = [self.memory[s] for s in coded.dictionary.to_pylist()]
        self.memory.trim()
        ends = np.concatenate([[0], np.cumsum(np.array([len(k) for k in known] or [0], np.int64)[coded.indices.to_numpy()])]) // 4 if len(coded) else np.zeros(1, np.int64)
        ids = pa.array(known, pa.binary()).take(coded.indices).buffers()[2] if ends[-1] else b""
        return lists(ids, ends[at - at[0]])

    def decode(self, rows: pa.ListArray) -> pa.BinaryArray:
        """The bytes of each row of ids, which lie one behind another as their tokens do."""
        at = np.concatenate([[0], np.cumsum(pc.list_value_length(rows).fill_null(0).to_numpy(), dtype=np.int64)])
        ids = rows.flatten()
        known = len(ids) == 0 or 0 <= pc.min(ids).as_py() <= pc.max(ids).as_py() < len(self.tokens)
        found = self.tokens.take(ids) if known else None
        if not known or ids.null_count or found.null_count:
            raise ValueError("an id that the vocabulary lacks")
        if not len(found):
            return pa.array([b""] * len(rows), pa.binary())
        _, begins, data = found.buffers()
        begins = np.frombuffer(begins, np.int32, len(found) + 1)
        return pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(begins[at].tobytes()), data])


def stretches_of(texts: pa.Array) -> pa.ListArray:
    """Texts cut where the byte-level pattern always begins a piece, whatever stands around: at lone spaces and line breaks."""
    odd = pc.match_substring_regex(texts, BeforeSpaces.odd)
    rows = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
    plain = BeforeSpaces.plain(texts.filter(pc.invert(odd)) if len(rows) else texts)
    if not len(rows):
        return plain
    slow = pa.array([BeforeSpaces.odd_text(t) for t in texts.take(pa.array(rows)).to_pylist()], plain.type)
    place = np.empty(len(texts), np.int64)
    place[rows] = len(plain) + np.arange(len(rows))
    place[np.setdiff1d(np.arange(len(texts)), rows)] = np.arange(len(plain))
    return pa.concat_arrays([plain, slow]).take(pa.array(place))


def lists(ids, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(ids, np.int32, ends[-1])))


def id_lists(rows: list[bytes]) -> pa.ListArray:
    return lists(b"".join(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows], dtype=np.int64)]) // 4)


def encode(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """(id, ids) for every row of ``docs``; ``ids`` is an array of int.

    NULL and empty texts have no ids; a NULL id stays NULL; rows that repeat are
    returned each; other columns are not read; an empty table gives an empty one.
    Texts of any length are read whole: above ``chunk + overlap`` characters they
    are divided among tasks. ``path`` names a rank file that every executor can
    open; special strings inside a text are ordinary text.
    """
    if not 0 < overlap < chunk:
        raise ValueError("the overlap must be shorter than the chunk")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    long = F.length("text") > chunk + overlap

    def run(batches):
        codec = Codec.of(path, pattern)
        for whole in batches:
            for batch in batches_by_bytes(whole, 1, BATCH):
                yield pa.RecordBatch.from_arrays([batch.column(0), codec.texts(batch.column(1))], ["id", "ids"])

    short = rows.filter(~long).mapInArrow(run, "id long, ids array<int>")
    return short.unionByName(encode_long(rows.filter(long), path, pattern, chunk, overlap)).withColumnRenamed("id", id_col)


def cut(rows: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """``rows(id, text)`` to (id, h, k, last, chunk): chunk k of the text with hash h begins at character k * chunk."""

    def run(batches):
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                h = hashlib.md5(text.encode()).hexdigest()
                starts = range(0, max(1, len(text) - overlap), chunk)
                for lo in range(0, len(starts), 16):
                    part = [(name, h, lo + k, at == starts[-1], text[at : at + chunk + overlap]) for k, at in enumerate(starts[lo : lo + 16])]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), types, strict=True)], ["id", "h", "k", "last", "chunk"])

    types = [pa.int64(), pa.string(), pa.int32(), pa.bool_(), pa.string()]
    return rows.mapInArrow(run, "id long, h string, k int, last boolean, chunk string")


def boundaries(pieces: list[str], size: int, last: bool) -> list[int]:
    """Ends of the pieces of a chunk of ``size`` characters that nothing beyond it can change."""
    ends = list(accumulate(map(len, pieces)))
    if last:
        return ends
    keep = len(ends)
    while keep and (ends[keep - 1] >= size or ends[keep - 1] - len(pieces[keep - 1]) + AHEAD > size):
        keep -= 1
    return ends[:keep]


def encode_long(rows: DataFrame, path: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """(id, ids) of ``rows(id, text)`` by chunks. Equal rows are encoded once; what comes together is one text's chunks."""
    key = ["id", "h"]

    def scan(batches):
        codec = Codec.of(path, pattern)
        for batch in batches:
            heads, tails = [], []
            for text, last in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ends = boundaries(codec.pieces(text), len(text), last)
                heads.append([0, *[e for e in ends if e <= overlap]])
                tails.append([e - chunk for e in ends if e >= chunk])
            cols = [batch.column(k) for k in range(2, batch.num_columns)]
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols, pa.array(heads, kind), pa.array(tails, kind)], names)

    names = ["chunk", "last", "id", "h", "k", "copies", "head", "tail"]
    ws = Workspace(rows.sparkSession, "byte-bpe")
    # Chunks of equal rows are equal, so any one of them stands for all.
    parts = cut(rows, chunk, overlap).groupBy(*key, "k").agg(F.count(F.lit(1)).alias("copies"), F.first("chunk").alias("chunk"), F.first("last").alias("last"))
    scanned = parts.select("chunk", "last", *key, "k", "copies").mapInArrow(
        scan, "chunk string, last boolean, id long, h string, k int, copies long, head array<int>, tail array<int>"
    )
    scanned = ws.keep(scanned, "scanned")
    along, text = W.partitionBy(*key).orderBy("k"), W.partitionBy(*key)
    met = F.array_min(F.array_intersect("tail", F.lead("head").over(along)))
    marked = scanned.withColumn("met", F.when(~F.col("last"), met)).drop("head", "tail")
    # A chunk's pieces run from where it met the one before to where it meets the next one.
    marked = marked.withColumn("lo", F.coalesce(F.lag("met").over(along), F.lit(0)))
    marked = ws.keep(marked.withColumn("whole", F.max(F.col("met").isNull() & ~F.col("last")).over(text)), "marked")

    def spans(batches):
        codec = Codec.of(path, pattern)
        for batch in batches:
            ids = []
            for t, lo, met in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                pieces = codec.pieces(t)
                ends = list(accumulate(map(len, pieces)))
                first = 0 if lo == 0 else ends.index(lo) + 1
                ids.append(codec.encode(islice(pieces, first, len(pieces) if met is None else ends.index(chunk + met) + 1)))
            codec.merged.trim()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(3, 7)), id_lists(ids)], ["id", "h", "k", "copies", "ids"])

    shape = "id long, h string, k int, copies long, ids array<int>"
    apart = marked.filter("not whole").select("chunk", "lo", "met", *key, "k", "copies").repartition(*key, "k").mapInArrow(spans, shape)
    own = F.when(F.col("last"), F.col("chunk")).otherwise(F.substring("chunk", 1, chunk))
    joined = marked.filter("whole").groupBy(*key).agg(F.max("copies").alias("copies"), F.array_sort(F.collect_list(F.struct("k", own.alias("own")))).alias("parts"))
    joined = joined.select(F.array_join("parts.own", "").alias("chunk"), F.lit(0).alias("lo"), F.lit(None).cast("int").alias("met"), *key, F.lit(0).alias("k"), "copies")
    pieces = apart.unionByName(joined.mapInArrow(spans, shape))
    texts = pieces.groupBy(*key).agg(F.max("copies").alias("copies"), F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("parts"))
    return texts.select("id", F.flatten("parts.ids").alias("ids"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("col")


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """Adds ``data``, the bytes that ``encoded(id, ids)`` stand for: their tokens' raw bytes one after another.

    They need not be valid UTF-8, as any ids can be decoded. A NULL array is
    empty; an id that the vocabulary lacks is an error.
    """

    def run(batches):
        codec = Codec.of(path, pattern)
        for whole in batches:
            ends = pc.list_value_length(whole.column(1)).fill_null(0).to_numpy().cumsum()
            at = 0
            while at < whole.num_rows:
                # About four bytes a token.
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BATCH // 4, side="right")))
                batch = whole.slice(at, to - at)
                at = to
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), codec.decode(batch.column(1))], [id_col, "ids", "data"])

    return encoded.select(id_col, "ids").mapInArrow(run, f"`{id_col}` long, ids array<int>, data binary")


def op12_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    # Written in between, so that a task never holds two Python workers.
    ids = Workspace(spark, "byte-bpe").keep(encode(table(spark, sf_dir, "documents"), path, pattern), "ids")
    out = decode(ids, path, pattern)
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed.cast("binary"), 256).alias("ids_sha256"), F.sha2("data", 256).alias("decoded_sha256")
    )
