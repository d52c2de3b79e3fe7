"""Text operators: brute force, SQL, held-out accuracy, odd rows."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from emberline.llm import decontamination as dc
from emberline.llm import language as lg
from emberline.llm import licenses as lc
from emberline.llm import mixing as mx
from emberline.llm import secrets as sc
from emberline.llm import toxicity as tx
from emberline.llm.common import Workspace, table


def docs(spark, rows, names="doc_id long, text string, lang string, source string, score int, size int"):
    width = len(names.split(","))
    return spark.createDataFrame([(*r, *[None] * (width - len(r))) for r in rows], names)


# Secrets ---------------------------------------------------------------------


def slow_spans(text):
    """The three fixed patterns, by Python's own engine."""
    out = []
    assign = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for m in re.finditer(assign, text, re.I | re.A):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, "assign", m.end()))
    for m in re.finditer("AKIA[A-Z0-9]+", text):
        if len(m[0]) >= 16:
            out.append((m.start(), 1, "access", m.end()))
    for m in re.finditer("[0-9a-f]+", text):
        if len(m[0]) >= 32:
            out.append((m.start(), 2, "hex", m.end()))
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(out))


PIECES = [
    "password", "PassWD", "token", "api_key", "apikey", "secret", " ", "=", ":", '"', "'", "abc", "0123456789abcdef" * 2, "0123456789abcdef", "AKIA", "AKIA12345678",
    "ABCD1234WXYZ", "é", "🙂", "\n", "-", "word", "x" * 9, "ſecret", "toKen",
]


def test_base_spans_against_python(spark):
    rng = random.Random(6)
    rows = [(k, "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 14)))) for k in range(800)]
    rows += [(800, None), (801, ""), (802, "token=aaaaaaaaa " * 300)]
    found = sc.base_spans(docs(spark, rows, "id long, text string").fillna(""))
    got = {r.id: r.spans for r in found.select("id", sc.listed("assign", "access", "hex").alias("spans")).collect()}
    assert got == {k: slow_spans(t or "") for k, t in rows}


def test_random_strings_are_added_and_words_are_not(spark):
    rng = random.Random(2)
    words = ["connection", "internationalisation_of_words", "understanding", "reconfiguration", "get_default_environment_name", "responsibility", "characteristically"]
    # What is ordinary is learned from shorter words.
    words += [w[k : k + 12] for w in words for k in range(0, len(w) - 6, 3)]
    rows = [(k, " ".join(rng.choice(words) for _ in range(60))) for k in range(300)]
    secret = "zQ7xV9kLm2Np4Rt8Wy1Bc3Df"
    rows += [(900, f"see {secret} here"), (901, f"token = {secret}"), (902, "see " + "understanding_reconfiguration" * 2), (None, secret), (903, None), (903, None)]
    got = sorted(sc.find_secrets(docs(spark, rows)).select("doc_id", sc.listed("assign", "markov").alias("s")).collect(), key=str)
    by = {r.doc_id: r.s for r in got}
    assert by[900] == f"markov:4:{4 + len(secret)}" and by[None] == f"markov:0:{len(secret)}"
    assert by[901] == f"assign:0:{8 + len(secret)}" and by[902] == "" and by[903] == ""
    assert all(by[k] == "" for k in range(300)) and len(got) == len(rows)
    assert sc.find_secrets(docs(spark, rows).limit(0)).count() == 0


def test_secret_digest(spark, sf_dir):
    rows = {r.doc_id: r for r in sc.op3_secrets(spark, sf_dir).collect()}
    for d in table(spark, sf_dir, "documents").collect():
        want = slow_spans(d.text or "")
        assert rows[d.doc_id].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(rows[d.doc_id].spans.split(","))


# Licences --------------------------------------------------------------------


def test_licences_are_found_and_inherited(spark):
    gpl, mit = "This work is licensed under the GNU General Public License, version 3.", "Released under the MIT License."
    rows = [
        (1, "a/LICENSE", gpl), (2, "a/x.txt", "some text"), (3, "a/b/c/y.txt", "deep"), (4, "a/b/LICENSE.md", mit), (5, "d/z.txt", "none"),
        (6, "d/own.txt", "Header.\nLicensed under CC BY-NC 4.0.\n" + "word " * 50), (7, "LICENSE", "Licensed under the Apache License, Version 2.0."),
        (8, None, None), (9, "a/b/odd.txt", ""), (9, "a/b/odd.txt", ""), (None, "a/null.txt", "text"), (10, "ab/q.txt", "x"),
    ]
    df = spark.createDataFrame(rows, "id long, path string, text string")
    got = [(r.id, r.license, r.origin, r.directory) for r in lc.license_files(df).collect()]
    by = {x[0]: x[1:] for x in got}
    assert by == {
        1: ("GPL-3.0", "own", None), 2: ("GPL-3.0", "directory", "a"), 3: ("MIT", "directory", "a/b"), 4: ("MIT", "own", None),
        5: ("Apache-2.0", "directory", ""), 6: ("CC-BY-NC-4.0", "own", None), 7: ("Apache-2.0", "own", None), 8: ("Apache-2.0", "directory", ""),
        9: ("MIT", "directory", "a/b"), None: ("GPL-3.0", "directory", "a"), 10: ("Apache-2.0", "directory", ""),
    }
    assert len(got) == len(rows) and lc.license_files(df.limit(0)).count() == 0


def test_leading_terms_lose_no_line():
    """No text without leading terms can reach the threshold."""
    lead = set(lc.leading_terms())
    weights = lc.template_weights()
    for k in range(len(lc.TEMPLATES)):
        rest = math.sqrt(sum(x * x for n, _, w, x in weights if n == k and w not in lead))
        assert rest < lc.THRESHOLD


# Mixing ----------------------------------------------------------------------


def water(sizes, weights, total, epochs=3):
    """Targets by dealing the excess again and again."""
    open_, target = set(sizes), {}
    left = float(total)
    while True:
        level = left / sum(weights[s] for s in open_) if open_ else 0
        above = {s for s in open_ if level * weights[s] > epochs * sizes[s]}
        if not above:
            return {**target, **{s: level * weights[s] for s in open_}}
        for s in above:
            target[s] = float(epochs * sizes[s])
            left -= target[s]
        open_ -= above


def test_mix_meets_targets(spark):
    rng = random.Random(8)
    rows = []
    for k in range(1500):
        source = rng.choice(["big"] * 6 + ["mid", "tiny", None, "é"])
        n = rng.choice([0, 1, 30, 300]) if source != "tiny" else rng.choice([0, 3])
        rows.append((rng.choice([k, None]), " ".join(["w"] * n) if n else rng.choice([None, "", "\n"]), None, source))
    df = docs(spark, rows)
    got = mx.mix(df).collect()
    sizes, by = {}, {}
    for _, text, _, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    order = sorted([s for s in sizes if s is not None]) + [None]
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    want = water(sizes, weights, sum(sizes.values()))
    size_of = {v: k for k, v in sizes.items()}
    assert len(size_of) == len(sizes) and len(got) == len(rows)
    for r in got:
        s = size_of[r.source_size]
        assert r.target == pytest.approx(want[s]) and r.taken <= 3 * r.size
        by[s] = by.get(s, 0) + r.taken
    for s in sizes:
        assert abs(by[s] - want[s]) <= 6 * mx.BLOCK_WORDS + 0.02 * want[s]
    again = mx.mix(df.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert mx.mix(df.limit(0)).count() == 0
    assert {(r.size, r.target, r.taken) for r in mx.mix(docs(spark, [(1, None), (2, "")])).collect()} == {(0, 0.0, 0)}


# Language --------------------------------------------------------------------


def test_language_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    known = {r.doc_id: r.lang for r in table(spark, sf, "documents").select("doc_id", "lang").collect()}
    rows = lg.op5_language(spark, sf).collect()
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {d for d in known if zlib.crc32(str(d).encode()) % 3 == 1}
    assert sum(known[r.doc_id] == r.lang_pred for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_rows(spark):
    rows = [(k, f"the cat sat on mat number and the dog {k}" if k % 2 else f"der hund und die katze nicht ein {k}", "en" if k % 2 else "de") for k in range(200)]
    rows += [(500, None, "en"), (501, "12 34 !!", None), (502, "", "de"), (None, "the cat and the dog", "de"), (503, "the dog " * 300_000, None), (504, "和 the", None)]
    got = {r.doc_id: r for r in lg.predict_language(docs(spark, rows)).collect()}
    assert [got[k].lang_pred for k in (500, 501, 502)] == ["und"] * 3 and got[501].score == 0
    assert got[None].lang_pred == "en" and got[None].held_out is False and got[503].lang_pred == "en"
    assert got[504].lang_pred in ("en", "de")
    assert lg.predict_language(docs(spark, [(1, "abc", None)])).first().lang_pred == "und"
    assert lg.predict_language(docs(spark, rows).limit(0)).count() == 0


def test_presence_kernel_against_sets():
    a, b = "Straße nach Süden", "strasse nach norden 12"
    x = lg.unit(lg.presence([a, b]).astype(np.float32))

    def grams(t):
        t = "".join(c if c.isalpha() else " " for c in t.lower()) + "    "
        return {(n, t[k : k + n]) for n in lg.GRAMS for k in range(len(t) - 4 + 0) if k + n <= len(t)}

    ga, gb = grams(a), grams(b)
    assert x[0] @ x[1] == pytest.approx(len(ga & gb) / math.sqrt(len(ga) * len(gb)), abs=0.02)
    long = "ab " * lg.PART
    assert (lg.presence([long]) == lg.presence(["ab " * 40])).all()


# Toxicity --------------------------------------------------------------------


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in tx.op7_toxicity(spark, sf).collect()}
    labels = [(rows[r.doc_id], r.toxic) for r in table(spark, sf, "labels").collect()]
    held = [(r, y) for r, y in labels if r.held_out]
    assert {r.doc_id for r, _ in held} == {r.doc_id for r, _ in labels if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    caught = [r.predicted for r, y in held if y == 1]
    clean = [r.predicted for r, y in held if y == 0]
    assert np.mean(caught) > 0.85 and np.mean(clean) < 0.02
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows.values())


def test_toxicity_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "you are fine"), (3, "a b"), (3, "a b")]
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in tx.score_toxicity(docs(spark, rows), none).collect()} == {0.0}
    one = spark.createDataFrame([(3, 1, 1), (3, 0, 0), (4, 1, None), (99, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = tx.score_toxicity(docs(spark, rows), one).collect()
    assert len(got) == 5 and {r.score for r in got} <= {0.0, 1.0}
    assert tx.score_toxicity(docs(spark, rows).limit(0), one).count() == 0


def test_toxicity_features():
    words = tx.Words({"idiot": 6.0, "mor*": 0.5, "moro*": 4.0})
    x = tx.features(pa.array(["You IDIOT! go\n away", None, "", "so 1d1ot and moronic far away from here none of it you", "fine"]), words)
    f = {name: x[:, k] for k, name in enumerate(tx.FEATURES)}
    assert f["log_words"].tolist() == pytest.approx([math.log1p(n) for n in (4, 0, 0, 12, 1)])
    assert f["strongest"].tolist() == [6.0, 0.0, 0.0, 6.0, 0.0]
    assert f["near_you"].tolist() == [0.25, 0.0, 0.0, 0.0, 0.0]
    assert f["obfuscated"][3] == pytest.approx(1 / 12) and f["capitals"][0] == 0.25 and f["exclaims"][0] == 0.25


# Decontamination -------------------------------------------------------------


def corpus(seed=3, n=60, vocabulary=150):
    rng = random.Random(seed)
    word = lambda: f"w{min(rng.randrange(vocabulary), rng.randrange(vocabulary))}"
    items = [(k, " ".join(word() for _ in range(rng.randint(3, 25))) + ". " + " ".join(word() for _ in range(rng.randint(1, 6))) + ".") for k in range(n)]
    texts = []
    for k in range(80):
        parts = [" ".join(word() for _ in range(rng.randint(0, 120)))]
        if k % 3 == 0:
            parts.insert(rng.randrange(2), items[rng.randrange(n)][1])
        texts.append(" ".join(parts))
    return items, texts


def index_of(items):
    df = {}
    for _, t in items:
        for w in set(dc.words_of(t)):
            df[w] = df.get(w, 0) + 1
    return dc.Index(items, df, len(items), sum(len(dc.words_of(t)) for _, t in items) / len(items)), df


def slow_scores(items, df, passage):
    """BM25 of every item with the passage as query, over its own score."""
    n, mean, out = len(items), sum(len(dc.words_of(t)) for _, t in items) / len(items), {}
    for k, t in items:
        ws = dc.words_of(t)
        part = {w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * ws.count(w) * (dc.K1 + 1) / (ws.count(w) + dc.K1 * (1 - dc.B + dc.B * len(ws) / mean)) for w in set(ws)}
        out[k] = sum(x for w, x in part.items() if w in passage) / sum(part.values())
    return out


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8])
def test_search_retrieves_every_item_above_the_threshold(threshold):
    items, texts = corpus()
    index, df = index_of(items)
    tid, at = dc.token_ids(pa.array(texts), dc.Terms(index))
    got = {}
    for d, item, score, _ in dc.search(index, tid, at, threshold):
        got.setdefault((d, index.ids[item]), []).append(score)
    want = {}
    for d, text in enumerate(texts):
        words = dc.words_of(text)
        for k in range(0, len(words), index.stride):
            for item, s in slow_scores(items, df, set(words[k : k + 2 * index.stride])).items():
                if s >= threshold - 1e-9:
                    want.setdefault((d, item), []).append(s)
    assert got.keys() == want.keys()
    for key in got:
        assert sorted(got[key]) == pytest.approx(sorted(want[key]))


def test_leaks_are_verified(spark):
    item = "The quick brown fox jumps over the lazy dog near the river bank today. It was red."
    near = item.replace("lazy", "sleepy")
    shuffled = " ".join(sorted(item.split()))
    rows = [
        (1, f"Intro words here. {item} And more."), (2, "clean text " * 40), (3, near), (4, shuffled), (5, None), (6, ""), (None, item), (7, item.upper()),
        (8, "x " * 50_000 + item), (9, item), (9, item), (10, "The quick brown fox jumps over the lazy dog near the river bank today."),
    ]
    bench = spark.createDataFrame([(70, item), (71, None), (72, ""), (73, "Other question about nothing at all. Answer."), (None, "zz")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in dc.find_leaks(docs(spark, rows), bench).collect()}
    assert got == {(d, 70) for d in (1, 3, None, 7, 8, 9)}
    assert dc.find_leaks(docs(spark, rows).limit(0), bench).count() == 0
    assert dc.find_leaks(docs(spark, rows), bench.limit(0)).count() == 0


def test_edited_and_cut_copies_leak(spark):
    question = "Which of the seven rivers of the northern plain carries the most silt to the sea in a dry year and why does the harbour town below the weir never flood."
    items = [(1, f"{question} B."), (2, f"{question.replace('seven', 'nine')} The slow river."), (3, "Name the old capital of the lake district. It is Varn by the water.")]
    rows = [
        (1, f"Intro. {question} C. More text follows here."), (2, f"Intro. {question.replace('seven', 'nine')} More text follows here."),
        (3, f"{question.replace('seven', 'nine').replace('silt', 'mud')} The fast river."), (4, "Name the old capital of the lake region. It is Varn by the water."),
        (5, "Name the old capital of the lake region. Nobody knows what that may be."), (6, " ".join(sorted(question.split())) + " B."), (7, "The slow river is B."),
    ]
    got = {(r.doc_id, r.item_id) for r in dc.find_leaks(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert {(1, 1), (2, 2), (3, 2), (4, 3)} <= got and not {d for d, _ in got} & {5, 6, 7}


def test_a_large_benchmark_is_searched_in_parts(spark):
    items, texts = corpus(n=40)
    bench = spark.createDataFrame(items, "item_id long, text string")
    parts = list(dc.build_indexes(bench, Workspace(spark, "t"), most=200))
    assert len(parts) > 2 and sorted(k for p in parts for k in p.ids) == list(range(40))
    whole = next(iter(dc.build_indexes(bench, Workspace(spark, "t"))))
    find = lambda ix: {(d, ix.ids[i], round(s, 9)) for d, i, s, _ in dc.search(ix, *dc.token_ids(pa.array(texts), dc.Terms(ix)))}
    best = lambda found: {(d, i): max(s for a, b, s in found if (a, b) == (d, i)) for d, i, _ in found}
    one = best(find(whole))
    many = best(set().union(*(find(p) for p in parts)))
    assert {k for k, s in one.items() if s > 0.9} <= set(many)
