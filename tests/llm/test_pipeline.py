"""The corpus pipeline stage by stage, on odd rows and as a whole."""

import os
import random
import subprocess
import sys

import corpus_pipeline as cp
from emberline.llm import mixing, simhash, toxicity
from emberline.llm.common import Workspace, table

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_stages_take_effect(spark):
    sf = "/root/testdata/sf0.01"
    ws, docs = Workspace(spark, "t"), table(spark, sf, "documents")
    seen = []
    for name, stage in cp.STAGES:
        out = ws.keep(stage(spark, docs, sf), "stage")
        seen.append((name, docs, out))
        if name != "token shards":
            assert out.columns == list(cp.COLUMNS)
        docs = out
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    (_, before, clean), (_, _, single), (_, _, free), (_, _, mixed), (_, _, tokens) = seen
    scores = {r.doc_id: r.predicted for r in toxicity.score_toxicity(before, table(spark, sf, "labels")).collect()}
    assert ids(clean) == {d for d, p in scores.items() if not p}
    texts = [r.text for r in single.collect()]
    groups = {r.id: r.component for r in simhash.simhash_components(clean).collect()}
    assert ids(single) == set(groups.values()) and len(texts) == len(set(texts))
    bench = [r.text for r in table(spark, sf, "benchmark").collect()]
    leaked = {r.doc_id for r in single.collect() if any(b in r.text for b in bench)}
    assert leaked and not leaked & ids(free) and len(ids(single)) - len(ids(free)) <= 2 * len(leaked)
    targets = {r.source: r.target for r in mixing.mix(free, carry=("source",)).collect()}
    words, longest = dict.fromkeys(targets, 0), dict.fromkeys(targets, 0)
    for r in mixed.collect():
        n = len(r.text.split())
        words[r.source] += n
        longest[r.source] = max(longest[r.source], n)
    assert all(abs(words[s] - t) <= longest[s] for s, t in targets.items())
    assert tokens.count() == mixed.count()


def test_odd_rows(spark, tmp_path):
    rows = [
        (1, "some words that stand here alone and mean nothing much at all", "en", "a", 5), (1, "some words that stand here alone and mean nothing much at all", "en", "a", 5),
        (2, None, None, None, None), (3, "", "en", "b", 0), (None, "no id but words in it", "en", None, 3), (None, "no id but words in it", "en", None, 3),
        (4, "other " * 30_000, "de", "b", 7), (2, "the same id again with words", "fr", "c", 1),
    ]
    df = spark.createDataFrame([(*r, "kept out", 1.0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, row string, score double")
    folder = str(tmp_path)
    df.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 0, 0), (4, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(9, "nothing of this stands in any text here")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    out = {name: f(spark, df, folder) for name, f in cp.STAGES}
    assert all(d.columns == list(cp.COLUMNS) for d in list(out.values())[:4])
    # NULL and empty texts have one fingerprint.
    assert out["simhash near-dedup"].count() == 5
    assert out["decontamination"].count() == 8 and out["token shards"].count() == 8
    assert {r.text for r in out["mixing"].collect()} <= {r[1] for r in rows}
    assert cp.run(spark, folder).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    empty = df.limit(0)
    assert [f(spark, empty, folder).count() for _, f in cp.STAGES] == [0] * 5


def test_rows_with_swapped_nulls_are_two_rows(spark, tmp_path):
    rows = [(1, "one text of words", None, "x", 3), (1, "one text of words", "x", None, 3), (2, "another text of words", "x", "x", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert cp.with_row(df).select("row").distinct().count() == 3
    mixed = [tuple(r) for r in cp.mix_sources(spark, df, str(tmp_path)).collect()]
    assert {(r[2], r[3]) for r in mixed} == {(None, "x"), ("x", None), ("x", "x")}
    assert len(cp.drop_copies(spark, df, str(tmp_path)).collect()) == 2


def test_copies_end_near_their_targets(spark):
    rng = random.Random(8)
    rows = [(k, " ".join(["w"] * rng.choice([1, 5, 30, 90, 400])), rng.choice(["a", "b", "c", None])) for k in range(400)]
    rows += [(500, None, "a"), (501, "", "e"), rows[0], rows[0], (None, "x y z", "b")]
    docs = spark.createDataFrame([(*r, f"r{r}") for r in rows], "doc_id long, text string, source string, name string")
    got = {r.name: r.copies for r in mixing.copies(docs, "name").collect()}
    targets = {r.source: r.target for r in mixing.mix(docs, carry=("source",)).collect()}
    size = {f"r{r}": len((r[1] or "").split()) for r in rows}
    for s, t in targets.items():
        words = sum(got.get(n, 0) * size[n] for n in {f"r{r}" for r in rows if r[2] == s})
        assert abs(words - t) <= 200, (s, words, t)
    assert all(0 < c <= 3 * rows.count(next(r for r in rows if f"r{r}" == n)) for n, c in got.items())
    assert mixing.copies(docs.limit(0), "name").count() == 0


def test_entry_works_without_the_subpackage(tmp_path):
    code = (
        "import sys, importlib.abc\n"
        "class Gone(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name == 'corpus_pipeline' or name.startswith('emberline.llm'):\n"
        "            raise ModuleNotFoundError(f'No module named {name!r}', name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "q = e.queries(); assert 'first_burn' in q and not any(k.startswith('op') for k in q) and 'pipeline' not in q; e.oracle_sql(); print('fine')\n"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert "fine" in done.stdout, done.stderr[-2000:]


def test_all_ten_and_the_pipeline_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(k.startswith(f"op{n}_") for k in names) for n in range(1, 11))
