"""Toxicity scores: gradient-boosted trees over dense text features, calibrated by isotonic regression.

Labels are learned from a bounded sample of rows outside the held-out fold, cut
in folds by crc32 of the id: the lexicon from folds 1 and 2, the trees from folds
1 to 3, the calibration from fold 4. The lexicon holds words and word beginnings
(``idio*``) whose presence tells toxic from other texts, by the likelihood-ratio
statistic. Every text is then turned into a few numbers in one pass: densities of
lexicon words, how often they stand near a word of the second person, capitals,
punctuation and obfuscated spellings.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, crc_mod, table
from .token_counts import batches_by_bytes

FOLDS = 5
#: Labelled rows to learn from (expected number; all of them where there are fewer).
TRAIN_ROWS = 30_000
#: Most units of the lexicon, and the least share of the strongest unit's statistic.
LEXICON_UNITS, LEXICON_SHARE = 400, 0.1
PREFIXES = (4, 5, 6)
#: Words within which a second-person word counts as near.
NEAR = 5
SECOND_PERSON = frozenset(
    "you your yours yourself yourselves u ur du dich dir dein deine deinen euch euer ihr tu te toi ton ta tes vous votre vos "
    "tú ti tus tuyo usted ustedes vosotros vosotras os".split()
)
FEATURES = [
    "log_words", "strong", "log_strong", "hits", "log_hits", "weight", "strongest", "near_you", "you", "capitals", "marks", "exclaims", "obfuscated",
]
#: Log odds from which a unit counts as strong.
STRONG = 3.0
#: Words whose attributes a worker remembers.
MEMORY = 300_000
_LEET = str.maketrans("013457@$!|", "oieastasil")


def units(word: str) -> list[str]:
    return [word, *(word[:k] + "*" for k in PREFIXES if len(word) >= k)]


class Words:
    """Attributes of single words: weight, second person, capitals, marks, exclamation, obfuscated, counts as a word."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon, self.memory = lexicon, {}

    def weight(self, core: str) -> float:
        return max([0.0, *(self.lexicon[u] for u in units(core) if u in self.lexicon)])

    def look(self, word: str) -> tuple:
        if not word:
            return 0.0, 0, 0, 0, 0, 0, 0
        core = word.strip(".,;:!?\"'()[]{}|*#%&$<>-_").lower()
        weight, odd = self.weight(core), 0
        if core and not core.isalpha():
            plain = core.translate(_LEET)
            letters = "".join(filter(str.isalpha, plain))
            odd = int(any(map(str.isalpha, core)) and "://" not in core)
            weight = max(weight, self.weight(letters)) if odd else weight
        capitals = int(len(core) > 1 and word.isupper())
        return weight, int(core in SECOND_PERSON), capitals, len(word) - len(core), word.count("!"), odd, 1

    def table(self, words: list[str]) -> np.ndarray:
        memory = self.memory
        if len(memory) > MEMORY:
            memory.clear()
        out = []
        for w in words:
            x = memory.get(w)
            if x is None:
                x = self.look(w)
                if len(w) <= 64:
                    memory[w] = x
            out.append(x)
        return np.array(out, np.float64).reshape(-1, 7)


def features(texts: pa.Array, words: Words) -> np.ndarray:
    """One row of FEATURES per text; NULL and empty texts have zeros."""
    plain = pc.fill_null(texts, "")
    for c in "\n\t\r\x0b\x0c":
        plain = pc.replace_substring(plain, c, " ")
    lists = pc.split_pattern(plain, " ")
    at = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.values.slice(at[0], at[-1] - at[0]).dictionary_encode()
    at = at - at[0]
    t = words.table(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
    # Pieces of white space alone are not words; the others are numbered on.
    real = t[:, 6] > 0
    at = np.concatenate([[0], np.cumsum(real)])[at]
    t = t[real]
    start, stop = at[:-1], at[1:]
    total = lambda x: (c := np.concatenate([[0.0], np.cumsum(x)]))[stop] - c[start]
    weight, you = t[:, 0], t[:, 1]
    hit = weight > 0
    of = np.repeat(np.arange(len(start)), stop - start)
    seen = np.concatenate([[0.0], np.cumsum(you)])
    place = np.arange(len(t))
    near = hit & (seen[np.minimum(place + NEAR + 1, stop[of])] - seen[np.maximum(place - NEAR, start[of])] > 0)
    strongest = np.zeros(len(start))
    np.maximum.at(strongest, of[hit], weight[hit])
    n = np.maximum(stop - start, 1)
    strong, hits = total(weight >= STRONG), total(hit)
    return np.stack([
        np.log1p(stop - start), strong / n, np.log1p(strong), hits / n, np.log1p(hits), total(weight) / n, strongest,
        total(near) / n, total(you) / n, total(t[:, 2]) / n, total(t[:, 3]) / n, total(t[:, 4]) / n, total(t[:, 5]) / n,
    ], axis=1)


def feature_table(docs: DataFrame, lexicon: dict[str, float], *extra: str) -> DataFrame:
    """``docs(text, *extra)`` to (*extra, x), x being the features as an array."""

    def run(batches):
        words = Words(lexicon)
        for whole in batches:
            for batch in batches_by_bytes(whole, 0, 8_000_000):
                x = features(batch.column(0), words)
                rows = pa.ListArray.from_arrays(np.arange(0, x.size + 1, len(FEATURES), dtype=np.int32), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in extra), rows], [*extra, "x"])

    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in extra), "x array<double>"])
    return docs.select("text", *(c for c in extra if c != "text")).mapInArrow(run, schema)


def learn_lexicon(sample: DataFrame) -> dict[str, float]:
    """Log odds of the units of ``sample(text, toxic)`` that tell the classes apart; at most LEXICON_UNITS."""
    sizes = sample.groupBy("toxic").count().collect()
    n = {r["toxic"]: r["count"] for r in sizes}
    bad, good = n.get(1, 0), n.get(0, 0)
    if not bad or not good:
        return {}
    words = F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+")))
    one = sample.select("toxic", words.alias("w")).filter("w <> ''")
    starts = [F.when(F.length("w") >= k, F.concat(F.substring("w", 1, k), F.lit("*"))) for k in PREFIXES]
    # Counted per word before the beginnings are cut; a text with two words of one beginning counts twice there.
    counts = one.groupBy("w").agg(F.sum("toxic").alias("a"), F.count(F.lit(1)).alias("n"))
    unit = counts.select(F.explode(F.array("w", *starts)).alias("unit"), "a", "n").filter("unit is not null")
    unit = unit.groupBy("unit").agg(F.sum("a").alias("a"), F.sum("n").alias("n")).filter("a >= 5")
    share = bad / (bad + good)
    a, b = F.col("a").cast("double"), (F.col("n") - F.col("a")).cast("double")
    part = lambda seen, expected: F.when(seen > 0, seen * F.ln(seen / expected)).otherwise(0.0)
    g2 = 2 * (part(a, F.col("n") * share) + part(b, F.col("n") * (1 - share)))
    odds = F.ln((a + 0.5) / (bad + 1)) - F.ln((b + 0.5) / (good + 1))
    found = unit.select("unit", odds.alias("odds"), g2.alias("g2")).filter("odds > 1").orderBy(F.desc("g2"), "unit").limit(LEXICON_UNITS).collect()
    most = max((r["g2"] for r in found), default=0.0)
    return {r["unit"]: r["odds"] for r in found if r["g2"] >= LEXICON_SHARE * most}


class Model:
    """Lexicon, trees and calibration; a constant where the labels hold one class only."""

    def __init__(self, lexicon, trees, calibration, constant: float):
        self.lexicon, self.trees, self.calibration, self.constant = lexicon, trees, calibration, constant

    def score(self, docs: DataFrame, *extra: str) -> DataFrame:
        """``docs(text, *extra)`` to (*extra, score)."""
        if self.trees is None:
            return docs.select(*extra, F.lit(self.constant).alias("score"))
        from pyspark.ml.functions import array_to_vector

        x = feature_table(docs, self.lexicon, *extra).withColumn("features", array_to_vector("x"))
        return raw_scores(self.trees, self.calibration, x).select(*extra, "score")


def raw_scores(trees, calibration, x: DataFrame) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    out = trees.transform(x).withColumn("raw", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")
    if calibration is not None:
        out = calibration.transform(out.withColumn("raw", F.col("raw"))).withColumnRenamed("prediction", "score")
    else:
        out = out.withColumn("score", F.col("raw"))
    return out.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "score")))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, iterations: int = 20, depth: int = 3) -> Model:
    """Learn from ``labels(doc_id, toxic)`` outside fold 0 of ``docs(doc_id, text)``.

    Several labels of one id count as toxic if one is; labels other than 0 and 1
    and labels without a document are not used.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.regression import IsotonicRegression

    ws = Workspace(docs.sparkSession, "toxicity")
    named = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    named = named.filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    named = named.withColumn("fold", crc_mod("doc_id", FOLDS)).filter("fold <> 0")
    n = named.count()
    share = min(1.0, rows / max(1, n))
    picked = named.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < round(share * 1_000_000))
    # Bounded by ``rows``, so broadcast; copies of one text count once.
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")
    sample = ws.keep(sample.filter("text is not null").dropDuplicates(["text"]), "sample")
    seen = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not seen.get(0) or not seen.get(1):
        return Model({}, None, None, float(bool(seen.get(1))))
    lexicon = learn_lexicon(sample.filter("fold in (1, 2)"))
    x = ws.keep(feature_table(sample, lexicon, "toxic", "fold"), "features")
    x = x.select(F.col("toxic").cast("double").alias("label"), "fold", array_to_vector("x").alias("features"))
    learned = x.filter("fold <> 4")
    if learned.select("label").distinct().count() < 2:
        return Model(lexicon, None, None, seen[1] / (seen[0] + seen[1]))
    trees = GBTClassifier(maxIter=iterations, maxDepth=depth, stepSize=0.3, minInstancesPerNode=5, seed=7).fit(learned)
    held = trees.transform(x.filter("fold = 4")).select("label", vector_to_array("probability")[1].alias("raw"))
    if held.select("label").distinct().count() < 2:
        return Model(lexicon, trees, None, 0.0)
    return Model(lexicon, trees, IsotonicRegression(featuresCol="raw").fit(held), 0.0)


def score_toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    Scores use the text alone. NULL texts count as empty; empty texts are scored
    like any other. Rows with a NULL id are scored and not held out; rows that
    repeat are scored each. Without labels of both classes every score is the
    class that is there, 0 where there is none. An empty table gives an empty
    one; other columns are not read.
    """
    model = train(docs, labels, **options)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = model.score(rows, "doc_id")
    held = F.coalesce(crc_mod("doc_id", FOLDS) == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
