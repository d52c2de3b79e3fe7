"""Filter interaction audit: what each filter removes, in every order of the filters.

A document is told by the mask of the filters it fails. In min-plus terms the
mask matrix (0 where a filter fails the document, no bound elsewhere) combined
with the inverse permutations of the orders (each filter's place in the order)
by minimum gives the step at which each order removes each mask. Documents are
therefore counted per part and mask first, and these counts are scattered over
(order, step) with the labels as further weights.

Whether a text stands under a smaller id is found without a join of the
documents to their copies: equal rows are counted per (text hash, part, mask,
labels) together with the rows of their smallest id, and only those counts meet
the smallest id of the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, table
from .token_counts import batches_by_bytes

LETTERS = "ABCDE"
#: The place of the filter on copies, which needs the whole table; the others look at one text.
COPIES = 4
MARKS = b"#$%&*|"
CAPITALS = bytes(range(65, 91))
#: Parts that are scattered at once.
PARTS = 64


def text_mask(text: bytes) -> int:
    """Bits of the filters A to D that fail a text in UTF-8."""
    words = text.split()
    points = len(text) - len(text.translate(None, _LEADS))
    capitals = len(text) - len(text.translate(None, CAPITALS))
    few, same = len(words) < 200, 100 * len(set(words)) < 50 * len(words)
    return few | same << 1 | (100 * capitals > 2 * points) << 2 | (len(text.translate(None, MARKS)) < len(text)) << 3


#: Bytes that begin a code point.
_LEADS = bytes(b for b in range(256) if b & 0xC0 != 0x80)


def text_masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(id, part, mask, h) for every row of ``docs``: filters A to D, and the SHA-256 of the text."""

    def run(batches):
        for whole in batches:
            for batch in batches_by_bytes(whole, 2, 8_000_000):
                texts = [t or b"" for t in batch.column(2).cast(pa.binary()).to_pylist()]
                masks = pa.array([text_mask(t) for t in texts], pa.int32())
                hashes = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), masks, hashes], ["id", "part", "mask", "h"])

    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).cast("string").alias("text")
    )
    return rows.mapInArrow(run, "id long, part string, mask int, h binary")


def mask_counts(rows: DataFrame, labels: DataFrame, ws: Workspace) -> DataFrame:
    """(part, mask, n, good, toxic) of ``rows(id, part, mask, h)``, with the bit of the copies filter set.

    ``labels(doc_id, quality, toxic)`` may hold several rows of an id: any 1
    counts. Rows with a NULL id have no label, are no copy, and make none.
    """
    one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(c)
    marks = labels.select(F.col("doc_id").cast("long").alias("id"), "quality", "toxic").filter("id is not null").groupBy("id").agg(one("quality"), one("toxic"))
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    key = ["h", "part", "mask", "quality", "toxic"]
    named = rows.filter("id is not null").join(marks, "id", "left").select("id", "h", "part", "mask", flag("quality"), flag("toxic"))
    named = named.groupBy("id", *key).agg(F.count(F.lit(1)).alias("c"))
    nameless = rows.filter("id is null").withColumns({"quality": F.lit(False), "toxic": F.lit(False)}).groupBy("id", *key).agg(F.count(F.lit(1)).alias("c"))
    known = F.when(F.col("id").isNotNull(), F.struct("id", "c"))
    alike = named.unionByName(nameless).groupBy(*key).agg(F.sum("c").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("c")).otherwise(0)).alias("free"), F.min(known).alias("first"))
    alike = ws.keep(alike, "alike")
    least = alike.groupBy("h").agg(F.min("first.id").alias("least"))
    own = F.when(F.col("first.id") == F.col("least"), F.col("first.c")).otherwise(0)
    alike = alike.join(least, "h").withColumn("fresh", F.col("free") + own)
    both = F.array(
        F.struct("mask", F.col("fresh").alias("n")), F.struct(F.col("mask").bitwiseOR(F.lit(1 << COPIES)).alias("mask"), (F.col("n") - F.col("fresh")).alias("n"))
    )
    split = alike.select("part", "quality", "toxic", F.inline(both)).filter("n > 0")
    share = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0))
    return split.groupBy("part", "mask").agg(F.sum("n").alias("n"), share("quality").alias("good"), share("toxic").alias("bad"))


def places(orders: Sequence[str], letters: str) -> np.ndarray:
    """(orders, filters): the step, from 1, at which each order applies each filter."""
    of = np.array([[letters.index(c) for c in order] for order in orders]).reshape(len(orders), len(letters))
    return np.argsort(of, axis=1) + 1


def removal_steps(masks: np.ndarray, places: np.ndarray) -> np.ndarray:
    """(masks, orders): the step that removes a mask; one more than the filters where none does."""
    k = places.shape[1]
    bound = np.where(masks[:, None] >> np.arange(k) & 1, 0, k + 1)
    return np.minimum((bound[:, None, :] + places[None]).min(-1, initial=k + 1), k + 1)


def audit(counts: DataFrame, letters: str = LETTERS, orders: Sequence[str] | None = None) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of ``counts(part, mask, n, good, bad)``.

    Bit i of a mask says that filter ``letters[i]`` fails. ``orders`` are all
    permutations where not given. A part has at most 2^filters rows, which come
    together in one row; parts are divided among tasks.
    """
    orders = list(orders) if orders is not None else ["".join(p) for p in permutations(letters)]
    k, many, place = len(letters), len(orders), places(orders, letters)
    at = np.argsort(place, axis=1)

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, PARTS):
                yield scatter(whole.slice(lo, PARTS))

    def scatter(batch):
        parts, lists = batch.column(0), batch.column(1)
        owner = np.repeat(np.arange(len(parts)), np.diff(lists.offsets.to_numpy()))
        mask, n, good, bad = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in lists.flatten().flatten())
        step = removal_steps(mask, place)
        shape = (len(parts), many, k + 2)
        cell = np.broadcast_to(owner[:, None], step.shape), np.broadcast_to(np.arange(many), step.shape), step
        lost = []
        for weight in (n, good, bad):
            sums = np.zeros(shape, np.int64)
            np.add.at(sums, cell, np.broadcast_to(weight[:, None], step.shape))
            lost.append(sums[:, :, 1 : k + 1])
        total = np.zeros(len(parts), np.int64)
        np.add.at(total, owner, n)
        kept = total[:, None, None] - np.cumsum(lost[0], axis=2)
        fails = (mask[:, None] >> np.arange(k) & 1).astype(bool)
        redundant = np.zeros((len(parts), many, k), np.int64)
        for s in range(k):
            late = fails[:, at[:, s]] & (step <= s)
            np.add.at(redundant[:, :, s], (owner[:, None], np.arange(many)[None]), n[:, None] * late)
        alone, shapley = np.zeros((2, len(parts), k), np.int64)
        for f in range(k):
            np.add.at(alone[:, f], owner, n * (mask == 1 << f))
            shapley[:, f] = lost[0][:, np.arange(many), place[:, f] - 1].sum(1)
        index = np.repeat(np.arange(len(parts)), many * k)
        wide = [kept, lost[0], redundant, alone[:, at], lost[1], lost[2], shapley[:, at]]
        cols = [parts.take(pa.array(index)), pa.array(orders * len(parts), pa.string()).take(pa.array(np.repeat(np.arange(len(parts) * many), k))),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(parts) * many)), *[pa.array(w.reshape(-1)) for w in wide]]
        return pa.RecordBatch.from_arrays(cols, names)

    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    packed = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "bad")).alias("counts"))
    return packed.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in names[3:]))


def audit_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """The audit of the filters A to E over ``docs``, all orders, per value of ``part_col``.

    NULL texts are empty, empty texts fail A alone (and E, where a smaller id has
    one too); a NULL part is the empty string; texts are read whole, whatever
    their length. Rows that repeat count each: E compares ids, so rows of one id
    do not fail each other, and a NULL id neither fails E nor makes another fail.
    An empty table gives an empty one; other columns are not read.
    """
    ws = Workspace(docs.sparkSession, "filter-audit")
    rows = ws.keep(text_masks(docs, id_col, text_col, part_col), "masks")
    return audit(ws.keep(mask_counts(rows, labels, ws), "counts"))


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    return audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_PLACE = ", ".join(f"case when mask[{i + 1}] then instr(filter_order, '{c}') else 6 end" for i, c in enumerate(LETTERS))

OP11_SQL = rf"""
with d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t from documents),
w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as words, min(doc_id) over (partition by t) as least from d),
l as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as bad from labels group by doc_id),
m as (select part, [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words),
                    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(w.doc_id > least, false)] as mask,
             coalesce(good, 0) as good, coalesce(bad, 0) as bad from w left join l on w.doc_id = l.doc_id),
g as (select part, mask, count(*) as n, sum(good) as good, sum(bad) as bad from m group by part, mask),
c as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
o as (select a.x || b.x || c.x || d.x || e.x as filter_order from c a, c b, c c, c d, c e
      where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
r as (select g.*, filter_order, least({_PLACE}) as gone from g, o),
k as (select unnest(range(1, 6)) as step),
s as (select part, filter_order, step,
             sum(case when gone > step then n else 0 end) as kept, sum(case when gone = step then n else 0 end) as removed,
             sum(case when mask[instr('ABCDE', substr(filter_order, step, 1))] and gone < step then n else 0 end) as redundant,
             sum(case when mask[instr('ABCDE', substr(filter_order, step, 1))] and list_sum(list_transform(mask, lambda x: x::int)) = 1 then n else 0 end) as unique_fails,
             sum(case when gone = step then good else 0 end) as good_lost, sum(case when gone = step then bad else 0 end) as toxic_lost
      from r, k group by part, filter_order, step)
select part, filter_order, step::int as step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant,
       unique_fails::bigint as unique_fails, good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost,
       (sum(removed) over (partition by part, substr(filter_order, step, 1)))::bigint as shapley
from s
"""
