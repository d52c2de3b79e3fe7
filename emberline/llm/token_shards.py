"""Token ids in shard files: a wavelet matrix with rank and select in each.

Layout of a file, little-endian: ``WMX1``, then n_ids, n_docs, levels (u64),
zeros of each level (u64), n_docs + 1 starts (u64), n_docs document ids with
their null flags, and for each level the lengths and zstd frames of its bits and
of its rank directory (ones before each 512 bits, u32). Level 0 holds the highest
bit in text order; level k + 1 holds the ids with zero bits at level k first,
both halves in their order.
"""

from __future__ import annotations

import struct
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Workspace, table
from .token_counts import GROUP_BYTES, LONG_PIECE, MEMORY, BeforeSpaces, Encoder, batches_by_bytes

MAGIC = b"WMX1"
BLOCK = 512
#: Ids that are dealt to both halves of a level at once; they stay in the processor's cache.
RUN = 1 << 15
#: Bytes of text encoded at once.
BATCH = 16_000_000
#: A mark behind a letter: the byte-level split always parts them. Only letters that every Unicode version has as letters.
MARKED = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f][.,;:!?|]\\z"
#: A shard is closed when it holds this many ids; a document is never divided.
SHARD_IDS = 1 << 22


class Coder:
    """Ids of texts as bytes; one for each vocabulary, id size and worker.

    The distinct pieces of a batch lose a mark behind their last letter, and
    what is left is looked up in a bounded memory or encoded by the library.
    """

    _made: dict = {}

    def __init__(self, path: str, code: str):
        self.encoder, self.code = Encoder.of(path), code
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str, code: str) -> Coder:
        if (path, code) not in cls._made:
            cls._made[path, code] = cls(path, code)
        return cls._made[path, code]

    @classmethod
    def forget(cls) -> None:
        """Workers outlive their stage; what they remember must not stand beside later ones."""
        for coder in cls._made.values():
            coder.young, coder.old = {}, {}
        pa.default_memory_pool().release_unused()

    def pack(self, ids) -> bytes:
        return array(self.code, ids).tobytes()

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and where each text begins and the last one ends."""
        lists = self.encoder.pieces(texts)
        at = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.values.slice(at[0], at[-1] - at[0]).dictionary_encode()
        values = self.values(coded.dictionary)
        size = pc.binary_length(values).to_numpy(zero_copy_only=False).astype(np.int64)
        kind = np.dtype(f"<u{array(self.code).itemsize}")
        index = coded.indices
        ends = np.concatenate([[0], np.cumsum(size[index.to_numpy()])]) // kind.itemsize
        data = values.take(index).buffers()[2] if len(index) else None
        return np.frombuffer(data, kind, ends[-1]) if data is not None else np.zeros(0, kind), ends[at - at[0]]

    def values(self, pieces: pa.Array) -> pa.Array:
        """The ids of distinct pieces as binary values."""
        if self.encoder.safe is not BeforeSpaces:
            return pa.array(self.encoder.learn(pieces.to_pylist(), self.pack), pa.binary())
        marked = pc.match_substring_regex(pieces, MARKED)
        cut = pc.utf8_slice_codeunits(pieces, 0, -1)
        coded = pc.if_else(marked, cut, pieces).dictionary_encode()
        known = pa.array(self.learn(coded.dictionary.to_pylist()), pa.binary()).take(coded.indices)
        if not pc.any(marked).as_py():
            return known
        ends = pc.if_else(marked, pc.utf8_slice_codeunits(pieces, -1), "").dictionary_encode()
        marks = pa.array(self.learn(ends.dictionary.to_pylist()), pa.binary()).take(ends.indices)
        return pc.binary_join_element_wise(known, marks, pa.scalar(b"", pa.binary()))

    def learn(self, pieces: list[str]) -> list[bytes]:
        out = list(map(self.young.get, pieces))
        group, rows, held, old = [], [], 0, self.old
        missing = [k for k, value in enumerate(out) if value is None]
        for k in missing:
            p = pieces[k]
            value = old.get(p)
            if value is not None:
                out[k] = self.young[p] = value
                continue
            group.append(p)
            rows.append(k)
            held += len(p)
            if held >= GROUP_BYTES:
                self._encode(group, rows, out)
                group, rows, held = [], [], 0
        self._encode(group, rows, out)
        if len(self.young) > MEMORY:
            self.young, self.old = {}, self.young
        return out

    def _encode(self, group: list[str], rows: list[int], out: list) -> None:
        for p, k, ids in zip(group, rows, self.encoder.encode(group), strict=True):
            out[k] = self.pack(ids)
            if len(p) <= LONG_PIECE:
                self.young[p] = out[k]


def halves(a: np.ndarray, bit: np.ndarray) -> tuple[np.ndarray, int]:
    """The ids without the bit, then those with it, both in their order, and how many come first."""
    low, high = [], []
    for at in range(0, len(a), RUN):
        part, own = a[at : at + RUN], bit[at : at + RUN]
        # By index: a mask of random bits is slow.
        low.append(part.take(np.flatnonzero(~own)))
        high.append(part.take(np.flatnonzero(own)))
    return np.concatenate([*low, *high]) if low else a, sum(map(len, low))


def pack(ids: np.ndarray, starts: np.ndarray, doc_ids: list, levels: int = 16) -> bytes:
    """The file for ``ids``; document k is ids[starts[k]:starts[k + 1]]."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=1).compress
    a = np.asarray(ids, np.uint16 if levels <= 16 else np.uint32)
    zeros, planes = [], []
    for level in range(levels):
        bit = (a & a.dtype.type(1 << (levels - 1 - level))) != 0
        bits = np.packbits(bit, bitorder="little")
        words = np.frombuffer(bits.tobytes() + b"\0" * (-len(bits) % 64), np.uint64)
        ones = np.bitwise_count(words).reshape(-1, BLOCK // 64).sum(1, dtype=np.uint64)
        rank = np.concatenate([[0], np.cumsum(ones)]).astype(np.uint32)
        planes += [squeeze(words.tobytes()), squeeze(rank.tobytes())]
        a, low = halves(a, bit)
        zeros.append(low)
    null = np.array([d is None for d in doc_ids], np.uint8)
    named = np.array([0 if d is None else d for d in doc_ids], np.int64)
    head = struct.pack("<QQQ", len(a), len(doc_ids), levels) + np.array(zeros, np.uint64).tobytes()
    body = b"".join(struct.pack("<Q", len(p)) + p for p in planes)
    return MAGIC + head + np.asarray(starts, np.uint64).tobytes() + named.tobytes() + null.tobytes() + body


class Shard:
    """Read access to one file; every method takes positions within the shard."""

    def __init__(self, data: bytes):
        import zstandard

        if data[:4] != MAGIC:
            raise ValueError("not a shard file")
        self.n, self.n_docs, self.levels = struct.unpack_from("<QQQ", data, 4)
        at = 28

        def take(count, kind):
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        self.zeros = take(self.levels, np.uint64).astype(np.int64)
        self.starts = take(self.n_docs + 1, np.uint64).astype(np.int64)
        named, null = take(self.n_docs, np.int64), take(self.n_docs, np.uint8)
        self.doc_ids = [None if z else int(d) for d, z in zip(named, null, strict=True)]
        self.words, self.ranks = [], []
        expand = zstandard.ZstdDecompressor().decompress
        for k in range(2 * self.levels):
            (size,) = struct.unpack_from("<Q", data, at)
            raw = expand(data[at + 8 : at + 8 + size])
            at += 8 + size
            (self.words if k % 2 == 0 else self.ranks).append(np.frombuffer(raw, np.uint64 if k % 2 == 0 else np.uint32))

    def _rank1(self, level: int, pos: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        pos = np.asarray(pos, np.int64)
        words, word = self.words[level], pos >> 6
        out = self.ranks[level][pos // BLOCK].astype(np.int64)
        first = (pos // BLOCK) * (BLOCK // 64)
        for k in range(BLOCK // 64 - 1):
            full = first + k < word
            if full.any():
                out[full] += np.bitwise_count(words[(first + k)[full]])
        cut = (pos & 63) > 0
        if cut.any():
            mask = (np.uint64(1) << (pos[cut] & 63).astype(np.uint64)) - np.uint64(1)
            out[cut] += np.bitwise_count(words[word[cut]] & mask)
        return out

    def _bit(self, level: int, pos: np.ndarray) -> np.ndarray:
        return (self.words[level][pos >> 6] >> (pos & 63).astype(np.uint64)) & np.uint64(1) > 0

    def access(self, positions) -> np.ndarray:
        """Ids at ``positions``."""
        pos = np.atleast_1d(np.asarray(positions, np.int64)).copy()
        out = np.zeros(len(pos), np.int64)
        for level in range(self.levels):
            bit, one = self._bit(level, pos), self._rank1(level, pos)
            out = out * 2 + bit
            pos = np.where(bit, self.zeros[level] + one, pos - one)
        return out

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        if not 0 <= token < 1 << self.levels:
            return 0, 0
        ends = np.clip(np.array([lo, max(lo, hi)], np.int64), 0, self.n)
        for level in range(self.levels):
            one = self._rank1(level, ends)
            ends = self.zeros[level] + one if token >> (self.levels - 1 - level) & 1 else ends - one
        return int(ends[0]), int(ends[1])

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """How often ``token`` stands in [lo, hi)."""
        a, b = self._range(token, lo, self.n if hi is None else hi)
        return max(0, b - a)

    def occurrences(self, token: int, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """Positions of ``token`` in [lo, hi), ascending: select, level by level upwards."""
        a, b = self._range(token, lo, self.n if hi is None else hi)
        pos = np.arange(a, max(a, b), dtype=np.int64)
        for level in reversed(range(self.levels)):
            if token >> (self.levels - 1 - level) & 1:
                pos = self._select(level, pos - self.zeros[level], True)
            else:
                pos = self._select(level, pos, False)
        return pos

    def _select(self, level: int, k: np.ndarray, one: bool) -> np.ndarray:
        """Position of the k-th (from 0) one or zero."""
        rank = self.ranks[level].astype(np.int64)
        before = rank if one else np.arange(len(rank), dtype=np.int64) * BLOCK - rank
        block = np.searchsorted(before, k, side="right") - 1
        lo, hi = block * BLOCK, np.minimum(block * BLOCK + BLOCK, self.n)
        while (hi - lo > 1).any():
            mid = (lo + hi) >> 1
            seen = self._rank1(level, mid)
            seen = seen if one else mid - seen
            lo, hi = np.where(seen <= k, mid, lo), np.where(seen <= k, hi, mid)
        return lo

    def decode(self) -> np.ndarray:
        """All ids in order, by undoing the levels from the last one up."""
        a = np.zeros(self.n, np.uint16 if self.levels <= 16 else np.uint32)
        for level in reversed(range(self.levels)):
            bit = np.unpackbits(self.words[level].view(np.uint8), count=self.n, bitorder="little").view(bool)
            up, low, high = np.empty_like(a), 0, self.zeros[level]
            a[high:] |= a.dtype.type(1 << (self.levels - 1 - level))
            for at in range(0, self.n, RUN):
                one = np.flatnonzero(bit[at : at + RUN])
                none = np.flatnonzero(~bit[at : at + RUN])
                part = up[at : at + RUN]
                part[none] = a[low : low + len(none)]
                part[one] = a[high : high + len(one)]
                low, high = low + len(none), high + len(one)
            a = up
        return a


SHARD_SCHEMA = "part int, seq int, n_docs long, n_ids long, file binary"


def levels_of(path: str, end_id: int) -> int:
    """Bits of the largest id of a vocabulary, the end id included."""
    if path.endswith(".model"):
        import sentencepiece

        most = sentencepiece.SentencePieceProcessor(model_file=path).get_piece_size() - 1
    else:
        from tokenizers import Tokenizer

        most = max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values())
    return max(1, max(most, end_id).bit_length())


def write_shards(docs: DataFrame, ws: Workspace, path: str, end_id: int = 2, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encode ``docs(id, text)`` in ascending id order and write one shard file per row.

    Rows are dealt by ranges of (id, hash of the text), so rows with one id or
    with none can be split. NULL ids come first; equal ids are ordered by the
    hash of the text, then the text. A NULL text is an empty one. The driver
    reads the vocabulary too, to see how many bits an id takes.
    """
    levels = levels_of(path, end_id)

    def run(batches):
        from pyspark import TaskContext

        coder, part, seq = Coder.of(path, "H" if levels <= 16 else "I"), TaskContext.get().partitionId(), 0
        held, names, sizes, n = [], [], [], 0

        def close():
            nonlocal held, names, sizes, seq, n
            starts = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
            data = pack(np.concatenate(held), starts, names, levels)
            row = [[part], [seq], [len(names)], [n], [data]]
            held, names, sizes, seq, n = [], [], [], seq + 1, 0
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types, strict=True)], ["part", "seq", "n_docs", "n_ids", "file"])

        for whole in batches:
            for batch in batches_by_bytes(whole, 1, min(BATCH, 4 * shard_ids)):
                ids, at = coder.texts(batch.column(1))
                held.append(np.insert(ids, at[1:], end_id))
                sizes.append(np.diff(at) + 1)
                n += len(held[-1])
                names += batch.column(0).to_pylist()
                if n >= shard_ids:
                    yield close()
        if names:
            yield close()

    dealt = docs.select("id", "text").withColumn("h", F.xxhash64("text")).repartitionByRange("id", "h").sortWithinPartitions("id", "h", "text")
    shards = dealt.select("id", "text").mapInArrow(run, SHARD_SCHEMA)
    # One shard, one file. The blocks are compressed already.
    return ws.keep(shards, "shards", compression="none", maxRecordsPerFile="1", **{"parquet.block.size": str(16 << 20)})


def read_documents(shards: DataFrame) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, decoded from the files."""

    def run(batches):
        # All texts are encoded by now.
        Coder.forget()
        for batch in batches:
            for part, seq, data in zip(*(batch.column(k).to_pylist() for k in range(2)), batch.column(2), strict=True):
                shard = Shard(data.as_py())
                ids = shard.decode().astype("<u4")
                raw, at = memoryview(ids.tobytes()), shard.starts
                crc = [zlib.crc32(raw[4 * at[k] : 4 * at[k + 1]]) for k in range(shard.n_docs)]
                n = shard.n_docs
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * n, pa.int32()), pa.array([seq] * n, pa.int32()), pa.array(shard.doc_ids, pa.int64()),
                     pa.array(at[:-1]), pa.array(np.diff(at)), pa.array(crc, pa.int64())],
                    ["part", "seq", "id", "at", "n_tokens", "ids_crc32"],
                )

    # Ids before a shard: sums per part, one row each, then within the part.
    sizes = shards.select("part", "seq", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    inside = F.sum("n_ids").over(W.partitionBy("part").orderBy("seq")) - F.col("n_ids")
    offsets = sizes.join(parts, "part").select("part", "seq", (F.col("before") + inside).alias("before"))
    docs = shards.select("part", "seq", "file").mapInArrow(run, "part int, seq int, id long, at long, n_tokens long, ids_crc32 long")
    return docs.join(offsets, ["part", "seq"]).select("id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_table(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Write the shards of ``docs`` and return (id, start, n_tokens, ids_crc32) read back from them.

    An empty text is its end id alone; an empty table writes no shard and gives
    no row; rows that repeat are written each; columns other than the two named
    ones are not read.
    """
    ws = Workspace(docs.sparkSession, "token-shards")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return read_documents(write_shards(rows, ws, path, **options)).withColumnRenamed("id", id_col)


def op9_token_shards(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_table(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
