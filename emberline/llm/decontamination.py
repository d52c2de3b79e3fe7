"""Benchmark passages in training texts: a BM25 index of the test items, searched by block-max WAND.

Scores are BM25 with the passage as query, divided by the item's score for
itself, so 1 means that the passage holds all terms of the item. Postings carry
this impact. Items lie in blocks of ids; a term has the maximum of its impacts
(for the whole list) and one for each block. Every text is read in passages of
two strides, a stride being as long as the longest item, so that a copied item
always lies in one passage. For each passage,

1. the sum of list maxima must reach the threshold (the WAND test),
2. then, for each block, the sum of its maxima,
3. then the score itself; and a hit is verified by comparing word runs of the
   item's question (all but its last sentence) and answer (the last one), or of
   the whole item. Short parts have shorter runs, so that one changed word never
   takes more than half of them.

The bounds are sums over the distinct terms of strides and never too small, so
every item above the threshold is found. All steps run on arrays of one batch.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, table
from .token_counts import AtSpaces, batches_by_bytes

K1, B = 1.2, 0.75
#: Share of an item's own score from which it is retrieved, and of its word runs from which it is verified.
THRESHOLD, OVERLAP = 0.5, 0.5
#: Share of the whole item's word runs that verifies a hit whatever its halves hold.
WHOLE = 0.8
RUN, ITEMS_PER_BLOCK, LEAST_STRIDE = 5, 8, 32
#: Words of items in one index; a larger benchmark is searched in several passes.
INDEX_WORDS = 2_000_000
_EDGE = ".,;:!?\"'()[]{}|*#%&$<>-_…“”„«»¿¡"


def word_of(token: str) -> str:
    return token.strip(_EDGE).lower()


def words_of(text: str | None) -> list[str]:
    return [w for w in map(word_of, (text or "").split()) if w]


def halves(text: str) -> tuple[list[str], list[str]]:
    """Words of the question (all but the last sentence) and of the answer; the last quarter is the answer of a single sentence."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+|\n+", text.strip()) if words_of(p)]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in words_of(p)], words_of(parts[-1])
    words = words_of(text)
    cut = len(words) - max(1, len(words) // 4)
    return words[:cut], words[cut:]


def runs(words, size: int = RUN) -> set:
    words = list(words)
    return {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()


def run_size(n: int) -> int:
    """Words in a run of a part of n words: RUN, or fewer where one word would lie in over half of the runs."""
    return max(1, min(RUN, (n + 1) // 3))


class Index:
    """Postings of ``items`` (id, text) with impacts, list and block maxima.

    ``df`` maps each term to the number of items of the whole benchmark that
    hold it; ``n`` and ``mean`` are their number and mean length.
    """

    def __init__(self, items: list[tuple], df: dict[str, int], n: int, mean: float):
        # Items that share terms come together, so that blocks bound them well.
        items = sorted(items, key=lambda x: (min(words_of(x[1]), key=lambda w: (df[w], w)), x[0] is None, x[0] or 0, x[1]))
        self.ids = [x[0] for x in items]
        words = [words_of(x[1]) for x in items]
        self.term = {w: k for k, w in enumerate(sorted({w for ws in words for w in ws}))}
        self.stride = max(LEAST_STRIDE, max(map(len, words)))
        lists: list[list[tuple[int, float]]] = [[] for _ in self.term]
        for k, ws in enumerate(words):
            count: dict[str, int] = {}
            for w in ws:
                count[w] = count.get(w, 0) + 1
            raw = {w: np.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * len(ws) / mean)) for w, c in count.items()}
            own = sum(raw.values())
            for w, score in raw.items():
                lists[self.term[w]].append((k, score / own))
        self.at = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
        self.item = np.array([k for x in lists for k, _ in x], np.int64)
        self.impact = np.array([s for x in lists for _, s in x])
        self.list_max = np.array([max(s for _, s in x) for x in lists])
        tops: list[dict[int, float]] = [{} for _ in lists]
        for top, x in zip(tops, lists, strict=True):
            for k, s in x:
                top[k // ITEMS_PER_BLOCK] = max(s, top.get(k // ITEMS_PER_BLOCK, 0.0))
        self.block_at = np.concatenate([[0], np.cumsum([len(t) for t in tops])])
        self.block = np.array([b for t in tops for b in t], np.int64)
        self.block_max = np.array([s for t in tops for s in t.values()])
        self.blocks = -(-len(items) // ITEMS_PER_BLOCK)
        cut = lambda ws: runs([self.term[w] for w in ws], run_size(len(ws)))
        self.parts = [tuple(map(cut, (*halves(x[1]), ws))) for x, ws in zip(items, words, strict=True)]

    def verify(self, item: int, passage: np.ndarray) -> tuple[float, float, float]:
        """Shares of the word runs of question, answer and whole item that the passage holds."""
        sizes = {len(r) for part in self.parts[item] for r in part}
        held = set().union(*(runs(passage.tolist(), s) for s in sizes))
        return tuple(len(part & held) / len(part) if part else 1.0 for part in self.parts[item])


def _expand(at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row its list at[row]:at[row + 1]: which row, and the place in the list."""
    n = at[rows + 1] - at[rows]
    of = np.repeat(np.arange(len(rows)), n)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + at[rows][of]


def search(index: Index, tid: np.ndarray, doc_at: np.ndarray, threshold: float = THRESHOLD) -> list[tuple[int, int, float, np.ndarray]]:
    """(document, item, score, passage) of all passages with score >= threshold; ``tid`` has a term or -1 for each word."""
    eps, v = 1e-9, len(index.term)
    n = np.diff(doc_at)
    strides = -(-n // index.stride)
    first = np.cumsum(strides) - strides
    doc_of_word = np.repeat(np.arange(len(n)), n)
    chunk = first[doc_of_word] + (np.arange(len(tid)) - doc_at[doc_of_word]) // index.stride
    doc_of = np.repeat(np.arange(len(n)), strides)
    total = len(doc_of)
    if not total:
        return []
    pair = np.unique(chunk[tid >= 0] * v + tid[tid >= 0])
    pair_chunk, pair_term = pair // v, pair % v
    two = np.append(doc_of[1:] == doc_of[:-1], False)  # the next stride is of the same text
    follow = lambda x: x + np.where(two.reshape(-1, *[1] * (x.ndim - 1)), np.concatenate([x[1:], x[:1]]), 0)
    live = follow(np.bincount(pair_chunk, index.list_max[pair_term], total)) >= threshold - eps
    out = []
    pair_at = np.searchsorted(pair_chunk, np.arange(total + 1))
    # Passages in groups, so that the expanded postings stay small.
    for some in np.array_split(np.flatnonzero(live), max(1, int(live.sum()) // 2000)):
        if not len(some):
            continue
        near = np.unique(np.concatenate([some, some[two[some]] + 1]))
        of, k = _expand(pair_at, near)
        o, b = _expand(index.block_at, pair_term[k])
        place = np.full(total + 1, len(near))
        place[near] = np.arange(len(near))
        sums = np.bincount(of[o] * index.blocks + index.block[b], index.block_max[b], (len(near) + 1) * index.blocks).reshape(-1, index.blocks)
        open_blocks = sums[place[some]] + np.where(two[some, None], sums[place[some + 1]], 0) >= threshold - eps
        rows = np.flatnonzero(open_blocks.any(axis=1))
        if not len(rows):
            continue
        # Distinct terms of both strides, then their postings in open blocks.
        a, ka = _expand(pair_at, some[rows])
        second = rows[two[some[rows]]]
        c, kc = _expand(pair_at, some[second] + 1)
        terms = np.unique(np.concatenate([rows[a] * v + pair_term[ka], second[c] * v + pair_term[kc]]))
        row, term = terms // v, terms % v
        o, p = _expand(index.at, term)
        keep = open_blocks[row[o], index.item[p] // ITEMS_PER_BLOCK]
        key, inverse = np.unique(row[o[keep]] * len(index.ids) + index.item[p[keep]], return_inverse=True)
        score = np.bincount(inverse, index.impact[p[keep]])
        for j in np.flatnonzero(score >= threshold - eps):
            at = some[key[j] // len(index.ids)]
            d = doc_of[at]
            lo = doc_at[d] + (at - first[d]) * index.stride
            out.append((int(d), int(key[j] % len(index.ids)), float(score[j]), tid[lo : min(lo + 2 * index.stride, doc_at[d + 1])]))
    return out


class Terms:
    """Term numbers of raw tokens, remembered per worker up to a bound: -1 for other words, -2 for none."""

    def __init__(self, index: Index):
        self.term, self.memory = index.term, {}

    def table(self, tokens: list[str]) -> np.ndarray:
        memory = self.memory
        if len(memory) > 400_000:
            memory.clear()
        out = list(map(memory.get, tokens))
        for k, x in enumerate(out):
            if x is None:
                w = word_of(tokens[k])
                out[k] = self.term.get(w, -1) if w else -2
                if len(tokens[k]) <= 64:
                    memory[tokens[k]] = out[k]
        return np.array(out, np.int64)


def token_ids(texts: pa.Array, terms: Terms) -> tuple[np.ndarray, np.ndarray]:
    """Term numbers of all words in order, and where each text begins; white space is what str.split takes for it."""
    texts = pc.fill_null(texts, "")
    if pc.any(pc.match_substring_regex(texts, AtSpaces.odd)).as_py():
        lists = pa.array([t.split() for t in texts.to_pylist()], pa.list_(pa.string()))
    else:
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
    at = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.values.slice(at[0], at[-1] - at[0]).dictionary_encode()
    tid = terms.table(coded.dictionary.to_pylist())[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64)
    real = tid != -2
    return tid[real], np.concatenate([[0], np.cumsum(real)])[at - at[0]]


def build_indexes(benchmark: DataFrame, ws: Workspace, most: int = INDEX_WORDS):
    """Indexes over parts of ``benchmark(item_id, text)``, with term statistics of the whole."""

    def run(batches):
        for batch in batches:
            words = [words_of(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(words, pa.list_(pa.string()))], ["item_id", "text", "words"])

    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = ws.keep(rows.mapInArrow(run, "item_id long, text string, words array<string>").filter(F.size("words") > 0), "items")
    n, total = items.agg(F.count(F.lit(1)), F.sum(F.size("words"))).first()
    if not n:
        return
    parts = -(-total // most)
    items = items.withColumn("part", F.pmod(F.xxhash64("text", "item_id"), F.lit(parts)))
    df = items.select(F.explode(F.array_distinct("words")).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    for part in range(parts):
        own = items.filter(F.col("part") == part)
        seen = own.select(F.explode("words").alias("w")).distinct().join(df, "w")
        # About INDEX_WORDS words and no more terms.
        texts = [(r["item_id"], r["text"]) for r in own.select("item_id", "text").collect()]
        if texts:
            yield Index(texts, {r["w"]: r["df"] for r in seen.collect()}, n, total / n)


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, overlap: float = OVERLAP, whole: float = WHOLE
) -> DataFrame:
    """(id, item_id, score, question_overlap, answer_overlap): one row for each text and item it leaks, best passage first.

    A text leaks an item if one of its passages scores at least ``threshold`` and
    holds at least ``overlap`` of the word runs of question and answer, or
    ``whole`` of those of the whole item. NULL and empty texts and items leak nothing; rows that repeat with one id count as one
    text; rows with a NULL id are searched like any other. Empty tables give an
    empty one; other columns are not read.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "decontamination")
    schema = "id long, item_id long, score double, question_overlap double, answer_overlap double"
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter("text is not null")
    found = None
    for index in build_indexes(benchmark, ws):
        held = spark.sparkContext.broadcast(index)

        def run(batches, held=held):
            index = held.value
            terms = Terms(index)
            for large in batches:
                for batch in batches_by_bytes(large, 1, 8_000_000):
                    tid, at = token_ids(batch.column(1), terms)
                    ids, out = batch.column(0).to_pylist(), []
                    for d, item, score, passage in search(index, tid, at, threshold):
                        q, a, w = index.verify(item, passage)
                        if (q >= overlap and a >= overlap) or w >= whole:
                            out.append((ids[d], index.ids[item], round(score, 6), q, a))
                    cols = list(zip(*out, strict=True)) or [[]] * 5
                    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["id", "item_id", "score", "question_overlap", "answer_overlap"])

        hits = rows.mapInArrow(run, schema)
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        found = spark.createDataFrame([], schema)
    best = found.groupBy("id", "item_id").agg(F.max(F.struct("score", "question_overlap", "answer_overlap")).alias("best"))
    return best.select(F.col("id").alias(id_col), "item_id", "best.*")


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
