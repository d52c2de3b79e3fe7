"""Vector code compression: parts of integer vectors as indexes into learned codebooks.

The nearest entry of a part is found through a grid: a part's coarse cell is its
key, and for each cell the entries are remembered that can be nearest to some
point of it. An entry whose least distance to the cell's box is above another
entry's greatest distance to it is nearest nowhere in the box; the others are
measured exactly. Nothing is lost: the nearest entry and all its ties are never
dominated. Vectors near each other share cells.

All arithmetic is in 64-bit integers. Each round is one pass over the stored
vectors: every task adds up its parts by entry, and Spark adds up the tasks. The
driver holds the codebooks alone, whose size does not depend on the table.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, table

UNITS, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Largest component in units of 1 / UNITS; squares and their sums stay within 64 bits.
LARGEST = 1 << 24
#: Vectors measured at once, and cells that each generation of a task's memory holds.
SLICE, CELLS = 1024, 100_000


def integer_vectors(df: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(id, label, v): floor(UNITS * x) of every vector without NULL or non-finite components."""

    def run(batches):
        for batch in batches:
            vectors = batch.column(2)
            size = np.diff(vectors.offsets.to_numpy()).astype(np.int64)
            flat = vectors.flatten()
            x = np.floor(flat.to_numpy(zero_copy_only=False).astype(np.float64) * UNITS)
            # The lists of NULL vectors are not in flat; they have no length here.
            size[vectors.is_null().to_numpy(zero_copy_only=False)] = 0
            bad = ~np.isfinite(x)
            owner = np.repeat(np.arange(len(size)), size)
            keep = vectors.is_valid().to_numpy(zero_copy_only=False).copy()
            keep[owner[bad]] = False
            x = x[keep[owner]]
            if len(x) and np.abs(x).max() > LARGEST:
                raise ValueError(f"a component is larger than {LARGEST // UNITS}")
            offsets = np.concatenate([[0], np.cumsum(size[keep])]).astype(np.int32)
            rows = pa.array(np.flatnonzero(keep))
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), lists], ["id", "label", "v"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    return rows.mapInArrow(run, f"id long, label {rows.schema['label'].dataType.simpleString()}, v array<int>")


class Cells:
    """Nearest entries of one part's codebook, by way of grid cells."""

    def __init__(self, book: np.ndarray):
        self.book, self.side = book, cell_side(book)
        self.real = book.astype(np.float64)
        self.norm = (self.real**2).sum(1)
        self.young: dict[bytes, np.ndarray] = {}
        self.old: dict[bytes, np.ndarray] = {}

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry to each row; the lowest index of several."""
        cells, at = np.unique(np.floor_divide(x, self.side), axis=0, return_inverse=True)
        found = [self._remembered(c.tobytes()) for c in cells]
        new = [k for k, entries in enumerate(found) if entries is None]
        for k, entries in zip(new, self.undominated(cells[new]), strict=True):
            found[k] = self.young[cells[k].tobytes()] = entries
        if len(self.young) > CELLS:
            self.young, self.old = {}, self.young
        size = np.array([len(f) for f in found])
        begins, n = (np.cumsum(size) - size)[at.ravel()], size[at.ravel()]
        first = np.cumsum(n) - n
        row = np.repeat(np.arange(len(x)), n)
        entry = np.concatenate(found)[np.repeat(begins - first, n) + np.arange(n.sum())]
        d = ((x[row] - self.book[entry]) ** 2).sum(1)
        best = np.minimum.reduceat(d, first)
        hit = np.flatnonzero(d == best[row])
        lowest = np.concatenate([[True], row[hit][1:] != row[hit][:-1]])
        return entry[hit[lowest]], best

    def _remembered(self, cell: bytes) -> np.ndarray | None:
        entries = self.young.get(cell)
        if entries is None and (entries := self.old.get(cell)) is not None:
            self.young[cell] = entries
        return entries

    def undominated(self, cells: np.ndarray) -> list[np.ndarray]:
        """For each cell the entries, ascending, that no other one is nearer than all over the cell's box.

        A box lies in a ball, so one matrix product rules out most entries; the
        others are compared by their exact distances to the box.
        """
        if not len(cells):
            return []
        width = self.book.shape[1]
        middle = cells * float(self.side) + (self.side - 1) / 2
        norm = (middle**2).sum(1)[:, None] + self.norm
        d = np.maximum(norm - 2.0 * (middle @ self.real.T), 0.0)
        diameter = (self.side - 1) * np.sqrt(width)
        reach = (np.sqrt(d.min(1, keepdims=True)) + diameter) ** 2
        # Above any rounding of the product.
        row, entry = np.nonzero(d <= reach * (1 + 1e-9) + norm * (4 * width + 16) * 2.0**-52)
        low = cells[row] * self.side
        below, above = low - self.book[entry], self.book[entry] - (low + self.side - 1)
        least = (np.maximum(np.maximum(below, above), 0) ** 2).sum(1)
        most = (np.maximum(np.abs(below), np.abs(above)) ** 2).sum(1)
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        keep = least <= np.minimum.reduceat(most, first)[row]
        return np.split(entry[keep], np.cumsum(np.bincount(row[keep], minlength=len(cells)))[:-1])


def cell_side(book: np.ndarray) -> int:
    """Side of the cells: an eighth of the usual distance between neighbouring entries, over the box's diagonal."""
    if len(book) < 2 or not book.shape[1]:
        return 1
    norms = (book.astype(np.float64) ** 2).sum(1)
    d = norms[:, None] + norms - 2.0 * book.astype(np.float64) @ book.T.astype(np.float64)
    np.fill_diagonal(d, np.inf)
    return max(1, int(np.sqrt(max(0.0, np.median(d.min(1)))) / (4 * np.sqrt(book.shape[1]))))


@dataclass(frozen=True)
class Codebooks:
    """``entries[part, entry, position]`` in units of 1 / UNITS."""

    entries: np.ndarray

    def sha256(self) -> str:
        """Of all components as decimals, by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def cells(self) -> list[Cells]:
        return [Cells(book) for book in self.entries]


def sliced(batch: pa.RecordBatch, column: int, dims: int):
    """Slices of a batch with their vectors as one matrix."""
    for lo in range(0, batch.num_rows, SLICE):
        part = batch.slice(lo, SLICE)
        flat = part.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        if len(flat) != part.num_rows * dims or (np.diff(part.column(column).offsets.to_numpy()) != dims).any():
            raise ValueError(f"a vector does not have {dims} components like the first one")
        yield part, flat.reshape(-1, dims)


def first_codebooks(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> Codebooks | None:
    """The parts of the vectors with the smallest ids, equal ids by their components; None of an empty table."""
    rows = vectors.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    if not rows:
        return None
    dims = len(rows[0].v)
    if not dims or dims % parts or any(len(r.v) != dims for r in rows):
        raise ValueError(f"vectors need one length that {parts} divides")
    whole = np.array([r.v for r in rows], np.int64)
    return Codebooks(np.stack(np.split(whole, parts, axis=1)))


def improve(vectors: DataFrame, books: Codebooks) -> Codebooks:
    """One round: every entry becomes floor(sum / count) of the parts nearest to it; entries without parts stay."""
    parts, n, width = books.entries.shape
    held = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        cells = held.value.cells()
        sums, counts = np.zeros((parts, n, width), np.int64), np.zeros((parts, n), np.int64)
        for batch in batches:
            for _, x in sliced(batch, 0, parts * width):
                for p in range(parts):
                    own = x[:, p * width : (p + 1) * width]
                    index, _ = cells[p].nearest(own)
                    np.add.at(sums[p], index, own)
                    counts[p] += np.bincount(index, minlength=n)
        part, entry = np.nonzero(counts)
        cols = [pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(counts[part, entry])]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(list(sums[part, entry]), pa.list_(pa.int64()))], ["part", "entry", "n", "s"])

    found = vectors.select("v").mapInArrow(run, "part int, entry int, n long, s array<long>")
    # At most parts * entries rows, whatever the table.
    rows = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[i]) for i in range(width)]).alias("s")).collect()
    held.destroy()
    new = books.entries.copy()
    for r in rows:
        new[r.part, r.entry] = [s // r.n for s in r.s]
    return Codebooks(new)


def assign(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """(id, label, code, error): two hex digits per part, and the squared distances summed over the parts."""
    parts, _, width = books.entries.shape
    held = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        cells = held.value.cells()
        for batch in batches:
            for part, x in sliced(batch, 2, parts * width):
                found = [cells[p].nearest(x[:, p * width : (p + 1) * width]) for p in range(parts)]
                digits = np.stack([index for index, _ in found], axis=1).astype(np.uint8).tobytes().hex()
                codes = [digits[k : k + 2 * parts] for k in range(0, len(digits), 2 * parts)]
                error = sum(d for _, d in found)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(codes, pa.string()), pa.array(error)], ["id", "label", "code", "error"])

    kind = vectors.schema["label"].dataType.simpleString()
    return vectors.select("id", "label", "v").mapInArrow(run, f"id long, label {kind}, code string, error long")


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits per part")
    books = first_codebooks(vectors, parts, entries)
    for _ in range(rounds if books else 0):
        books = improve(vectors, books)
    return books


def compress(
    df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
) -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) of every row with a whole finite vector.

    Rows whose vector is NULL or holds NULL or non-finite components are left
    out. NULL ids come last where the first vectors are chosen; equal ids are
    ordered by their components, and rows that repeat are kept each. Fewer rows
    than ``entries`` make smaller codebooks; of equally near entries the lowest
    index is taken. Labels may be NULL, which is a group of its own. Vectors of
    different lengths, or with components beyond 16,384, are an error. An empty
    table gives an empty one; other columns are not read.
    """
    ws = Workspace(df.sparkSession, "vector-codes")
    vectors = ws.keep(integer_vectors(df, id_col, vec_col, label_col), "vectors")
    books = train(vectors, parts, entries, rounds)
    if books is None:
        return vectors.select(F.col("id").alias(id_col), F.lit("").alias("code"), *[F.lit(0).cast("long").alias(c) for c in ("error", "label_error")], F.lit("").alias("codebooks_sha256"))
    coded = ws.keep(assign(vectors, books), "codes")
    sums = ws.keep(coded.groupBy(F.col("label").alias("name")).agg(F.sum("error").alias("label_error")), "sums")
    out = coded.join(sums, F.col("label").eqNullSafe(F.col("name")))
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"))


def _round_sql(k: int) -> str:
    """Distances |x|^2 - 2xc + |c|^2 are exact in doubles here; b is the codebook before round k."""
    return f"""
a{k} as materialized (select id, label, part, v, min(struct_pack(d := list_inner_product(v, v) - 2 * list_inner_product(v, c) + list_inner_product(c, c), e := entry)) as near
       from p join b{k} using (part) group by id, label, part, v),
b{k + 1} as materialized (select b{k}.part, entry, coalesce(s.c, b{k}.c) as c from b{k} left join (
       select part, entry, list(floor(total / n) order by pos) as c from (
         select part, near.e as entry, pos, sum(v[pos])::double as total, count(*) as n from a{k}, (select unnest(range(1, 17)) as pos) group by 1, 2, 3)
       group by part, entry) s using (part, entry))"""


OP13_SQL = f"""
with kept as (select vec_id as id, label, list_transform(embedding, lambda x: floor(1024 * x::double)) as v from embeddings
              where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as materialized (select id, label, part, v[part * 16 + 1 : part * 16 + 16]::double[16] as v from kept, (select unnest(range(4)) as part)),
b0 as materialized (select part, row_number() over (partition by part order by id) - 1 as entry, v as c from p where id in (select id from kept order by id limit 256)),
{",".join(_round_sql(k).replace("list(floor(total / n) order by pos) as c", "list(floor(total / n) order by pos)::double[16] as c") for k in range(ROUNDS))},
z as (select id, label, part, min(struct_pack(d := list_inner_product(v, v) - 2 * list_inner_product(v, c) + list_inner_product(c, c), e := entry)) as near
      from p join b{ROUNDS} using (part) group by id, label, part),
r as (select id, label, string_agg(printf('%02x', near.e), '' order by part) as code, sum(near.d)::bigint as error from z group by id, label),
h as (select sha256(string_agg(x::bigint::varchar, ',' order by part, entry, pos)) as codebooks_sha256
      from (select part, entry, unnest(c::double[]) as x, generate_subscripts(c::double[], 1) as pos from b{ROUNDS}))
select id as vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from r, h
"""
