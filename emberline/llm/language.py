"""Language of a text by a string kernel.

The kernel of two texts is the number of character n-grams (n = 1 to 4, hashed to
2^14 bins) that both hold, divided by the geometric mean of their numbers: a
blended spectrum of presence. Landmark texts give a Nyström map of the kernel, and
one ridge regression per language is fitted on it. As the kernel with a landmark
is linear in the presence vector, landmarks and weights fold into one matrix, and
a batch is scored by one product.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, table
from .token_counts import batches_by_bytes

FOLDS, HELD_OUT = 3, 1
#: Texts to learn from and landmarks among them, over all languages (expected numbers).
TRAIN_ROWS, LANDMARKS = 3_000, 256
GRAMS = (1, 2, 3, 4)
BINS = 1 << 14
RIDGE = 1e-3
#: Divides the regressions' values before they become probabilities.
TEMPERATURE = 0.2
#: Rows of a product, and characters of a text looked at together; a longer text is read in overlapping parts.
ROWS, PART = 512, 1 << 20
UNKNOWN = "und"

_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


def _is_letter() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x3000)])


_LETTER = _is_letter()


def presence(texts: list[str]) -> np.ndarray:
    """0/1 rows of hashed n-grams of lower-case letters; anything else is a space."""
    out = np.zeros((len(texts), BINS), np.uint8)
    parts, rows, own = [], [], []
    pad = " " * max(GRAMS)
    for k, text in enumerate(texts):
        text = text.lower()
        for at in range(0, max(1, len(text)), PART):
            parts.append(text[at : at + PART + len(pad)])
            rows.append(k)
            # n-grams that begin in the overlap belong to the next part.
            own.append(PART if at + PART < len(text) else len(parts[-1]) + len(pad))
    codes = np.frombuffer((pad.join(parts) + pad).encode("utf-32-le"), np.uint32)
    size = np.array([len(p) + len(pad) for p in parts])
    row = np.repeat(np.array(rows), size)
    place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    mine = place < np.repeat(np.array(own), size)
    known = np.minimum(codes, 0x2FFF)
    codes = np.where(_LETTER[known] | (codes >= 0x3000), codes, np.uint32(32))
    n = len(codes) - max(GRAMS)
    mine = np.flatnonzero(mine[:n])
    inside = row[mine] * BINS
    hashed = np.zeros(n, np.uint32)
    flat = out.reshape(-1)
    for k in GRAMS:
        hashed = (hashed + codes[k - 1 : k - 1 + n]) * _MULTIPLIERS[k - 1]
        hashed ^= hashed >> np.uint32(15)
        flat[inside + (hashed[mine] & np.uint32(BINS - 1))] = 1
    return out


def unit(x: np.ndarray) -> np.ndarray:
    """Presence rows divided by the root of their number, so that products are kernels."""
    return x / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True, dtype=np.float32), 1))


class Classifier:
    """``matrix`` (bins x languages) and ``bias`` give one value per language for a unit presence row."""

    def __init__(self, languages: list[str], matrix: np.ndarray, bias: np.ndarray):
        self.languages, self.matrix, self.bias = languages, matrix, bias

    @classmethod
    def fit(cls, x: np.ndarray, languages: np.ndarray, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Classifier:
        names = sorted(set(languages))
        # The landmarks are the first rows of each language; the rows come in hash order.
        each = max(1, landmarks // len(names))
        chosen = np.concatenate([np.flatnonzero(languages == name)[:each] for name in names])
        x = unit(x.astype(np.float32))
        marks = x[chosen]
        value, vector = np.linalg.eigh((marks @ marks.T).astype(np.float64))
        root = vector / np.sqrt(np.maximum(value, 1e-6 * value.max())) @ vector.T
        mapped = (x @ marks.T) @ root
        mean = mapped.mean(axis=0)
        goal = np.where(languages[:, None] == np.array(names)[None, :], 1.0, -1.0)
        centred = mapped - mean
        gram = centred.T @ centred + ridge * len(x) * np.eye(len(chosen))
        weights = np.linalg.solve(gram, centred.T @ (goal - goal.mean(axis=0)))
        return cls(names, (marks.T @ (root @ weights)).astype(np.float32), goal.mean(axis=0) - mean @ weights)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        value = (unit(presence(texts).astype(np.float32)) @ self.matrix + self.bias) / TEMPERATURE
        odds = np.exp(value - value.max(axis=1, keepdims=True))
        odds /= odds.sum(axis=1, keepdims=True)
        best = odds.argmax(axis=1)
        return [self.languages[k] for k in best], odds[np.arange(len(best)), best]


def train(docs: DataFrame, rows: int = TRAIN_ROWS, landmarks: int = LANDMARKS) -> Classifier | None:
    """Learn from about ``rows`` texts with a language outside the held-out fold, as many of each language; None without any."""
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    named = named.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_mod("doc_id", FOLDS) != HELD_OUT))
    # One row per language.
    count = {r["lang"]: r["count"] for r in named.groupBy("lang").count().collect()}
    if not count:
        return None
    share = {name: min(1.0, rows / len(count) / n) for name, n in count.items()}
    limit = F.create_map(*[F.lit(v) for name, s in share.items() for v in (name, round(s * 1_000_000))])[F.col("lang")]
    picked = named.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < limit)

    def run(batches):
        for whole in batches:
            for batch in batches_by_bytes(whole, 1, 2_000_000):
                for k in range(0, batch.num_rows, ROWS):
                    part = batch.slice(k, ROWS)
                    x = np.packbits(presence(part.column(1).to_pylist()), axis=1)
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "lang", "x"])

    # Bounded by ``rows``: a presence vector has 2 KB.
    found = picked.mapInArrow(run, "doc_id long, lang string, x binary").orderBy(F.xxhash64("doc_id"), "doc_id", "lang", "x").toArrow()
    if not found.num_rows:
        return None
    x = np.frombuffer(b"".join(found.column("x").to_pylist()), np.uint8).reshape(found.num_rows, -1)
    return Classifier.fit(np.unpackbits(x, axis=1), np.array(found.column("lang").to_pylist(), object).astype(str), landmarks)


def predict_language(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of ``docs``.

    A prediction reads the whole text and nothing else. ``und`` with score 0
    stands for a text that is NULL or has no letter, and for any text where there
    is nothing to learn from. Rows with a NULL id are predicted, not learned from
    and not held out; rows that repeat are predicted each; ties go to the first
    language in code-point order. An empty table gives an empty one.
    """
    model = train(docs, **options)

    def run(batches):
        for whole in batches:
            for batch in batches_by_bytes(whole, 1, 2_000_000):
                for k in range(0, batch.num_rows, ROWS):
                    part = batch.slice(k, ROWS)
                    letters = pc.fill_null(pc.match_substring_regex(part.column(1), r"\p{L}"), False).to_numpy(zero_copy_only=False)
                    names, scores = np.full(part.num_rows, UNKNOWN, object), np.zeros(part.num_rows)
                    rows = np.flatnonzero(letters)
                    if model is not None and len(rows):
                        names[rows], scores[rows] = model.predict(part.column(1).take(pa.array(rows)).to_pylist())
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(run, "doc_id long, lang_pred string, score double")
    held = F.coalesce(crc_mod("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op5_language(spark, sf_dir: str) -> DataFrame:
    return predict_language(table(spark, sf_dir, "documents"))
