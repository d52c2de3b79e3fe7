"""Filter audit, byte-level BPE and vector codes against brute force."""

import base64
import hashlib
import random
from itertools import permutations

import numpy as np
import public_tokenizers
import pytest

from emberline.llm import byte_bpe as bb
from emberline.llm import filter_audit as fa
from emberline.llm import vector_codes as vc

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


# Filter audit ----------------------------------------------------------------


def failing(rows):
    """Per row the set of failing filters, by their wording."""
    out = []
    for d, text, _ in rows:
        text = text or ""
        words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
        bad = set()
        if len(words) < 200:
            bad.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            bad.add("B")
        if 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text):
            bad.add("C")
        if any(c in "#$%&*|" for c in text):
            bad.add("D")
        if d is not None and any(e is not None and e < d and (t or "") == text for e, t, _ in rows):
            bad.add("E")
        out.append(bad)
    return out


def brute_audit(rows, labels):
    good = {d for d, q, _ in labels if d is not None and q == 1}
    toxic = {d for d, _, t in labels if d is not None and t == 1}
    bad, out = failing(rows), {}
    for part in {s or "" for _, _, s in rows}:
        mine = [(d, b) for (d, _, s), b in zip(rows, bad, strict=True) if (s or "") == part]
        lost = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for k, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                lost[f] += len(gone)
                fails = sum(f in b for _, b in mine)
                out[part, "".join(order), k] = [len(left), len(gone), fails - len(gone), sum(b == {f} for _, b in mine), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)]
        for (p, order, k), v in out.items():
            if p == part:
                v.append(lost[order[k - 1]])
    return out


WORDS = [f"w{k}" for k in range(150)]


def audit_rows():
    rng, rows = random.Random(4), []
    for d in range(60):
        n = rng.choice([3, 199, 200, 260])
        words = [rng.choice(WORDS[: rng.choice([40, 150])]) for _ in range(n)]
        text = rng.choice([" ", "\n", "\t\x0b "]).join(words) + rng.choice(["", " É x", " A B C D E F G H I J K L M N O P Q R", " 5 %", " |"])
        rows.append((rng.choice([d, d, None, 7]), text, rng.choice(["a", "b", "", None])))
    rows += [(100 + k, rows[k % 9][1], rng.choice(["a", "b"])) for k in range(30)]
    rows += [rows[3], rows[3], (200, None, "c"), (201, "", "c"), (None, None, "c"), (300, "word " * 300_000, "long")]
    return rows


def test_filter_audit_equals_brute_force(spark):
    rows = audit_rows()
    labels = [(d, k % 2, k % 3 == 0) for k, (d, _, _) in enumerate(rows)] + [(7, 1, 0), (None, 1, 1), (8, None, None)]
    labels = [(d, q, None if t is None else int(t)) for d, q, t in labels]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, source string, part string, mask int").repartition(5)
    marks = spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, h string")
    out = fa.audit_documents(docs, marks).collect()
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in out}
    assert len(out) == len(got) and got == brute_audit(rows, labels)
    assert fa.audit_documents(docs.limit(0), marks).count() == 0
    assert sum(r.removed for r in fa.audit_documents(docs, marks.limit(0)).collect()) == sum(v[1] for v in got.values())


def test_removal_steps_of_given_orders(spark):
    place = fa.places(["BA", "AB"], "AB")
    assert place.tolist() == [[2, 1], [1, 2]]
    assert fa.removal_steps(np.array([0, 1, 2, 3]), place).tolist() == [[3, 3], [2, 1], [1, 2], [1, 1]]
    counts = spark.createDataFrame([("p", 1, 5, 2, 0), ("p", 3, 4, 0, 1), ("p", 0, 6, 6, 0)], "part string, mask int, n long, good long, bad long")
    rows = {(r.filter_order, r.step): r for r in fa.audit(counts, "AB", ["BA"]).collect()}
    assert (rows["BA", 1].removed, rows["BA", 2].removed, rows["BA", 2].redundant, rows["BA", 2].kept) == (4, 5, 4, 6)


# Byte-level BPE --------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


PIECES = ["'re", "'", "r", "e", "'ll", "don't", " the", "the ", "  ", "\n", "\t", " ", "12", "3", "é", "日本", "🙂", "!!", "<|endoftext|>", "\x00", "　", "word", "a" * 30, " " * 25, "́"]


def test_chunks_give_the_ids_of_whole_texts(spark, library):
    rng = random.Random(9)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    texts += ["x" * 500, " " * 333 + "y", "ab " * 200, "", None]
    rows = [(k, t, b"", 5) for k, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, texts[7], b"", 1), (None, texts[7], b"", 1), (5, "other " * 30, b"", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, data binary, ids int").repartition(3)
    want = sorted(((d is None, d or 0, t or "", library.encode_ordinary(t or "")) for d, t, *_ in rows))
    for chunk, overlap in ((41, 12), (17, 5), (64, 63), (bb.CHUNK, bb.OVERLAP)):
        coded = bb.encode(docs, RANKS, PATTERN, chunk=chunk, overlap=overlap)
        got = bb.decode(coded, RANKS, PATTERN).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0, bytes(r.data).decode(), r.ids) for r in got) == want
    assert bb.encode(docs.limit(0), RANKS, PATTERN).count() == 0
    with pytest.raises(ValueError):
        bb.encode(docs, RANKS, PATTERN, chunk=5, overlap=5)


def test_very_long_texts(spark, library):
    rng = random.Random(2)
    texts = ["".join(rng.choice(PIECES) + " " for _ in range(60_000)), "z" * 200_000, "one two three " * 40_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.ids for r in bb.encode(docs, RANKS, PATTERN).collect()}
    assert got == {k: library.encode_ordinary(t) for k, t in enumerate(texts)}


def test_memory_of_pieces_is_bounded(monkeypatch):
    monkeypatch.setattr(bb, "MEMORY", 10)
    memory = bb.Memory(lambda piece: (len(piece),))
    for k in range(200):
        assert memory[f"p{k % 30}"] == (len(f"p{k % 30}"),)
        memory.trim()
        assert len(memory) <= 10 and len(memory.old) <= 11
    memory["x" * 100]
    assert "x" * 100 not in memory


def test_decoding_any_ids(spark):
    df = spark.createDataFrame([(1, [128, 200]), (2, None), (3, []), (4, [50255])], "doc_id long, ids array<int>").coalesce(1)
    token = bb.Codec.of(RANKS, PATTERN).tokens.to_pylist()
    for rows in (df, df.filter("doc_id in (2, 3)")):
        got = {r.doc_id: bytes(r.data) for r in bb.decode(rows, RANKS, PATTERN).collect()}
        assert got.items() <= {1: token[128] + token[200], 2: b"", 3: b"", 4: token[50255]}.items() and len(got) > 1
    with pytest.raises(Exception, match="lacks"):
        bb.decode(spark.createDataFrame([(1, [50256])], "doc_id long, ids array<int>"), RANKS, PATTERN).collect()


# Vector codes ----------------------------------------------------------------


def brute_codes(rows, entries=256, rounds=4):
    """Codes, errors and final entries with every distance computed."""
    kept = [(d, np.floor(1024 * np.array(v, float)).astype(np.int64), label) for d, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    x = np.array([v for _, v, _ in kept]).reshape(len(kept), 4, -1)
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1].tolist()))[:entries]
    books = np.swapaxes(x[first], 0, 1).copy()

    def near(p):
        d = ((x[:, p, None, :] - books[p][None]) ** 2).sum(-1)
        return d.argmin(1), d.min(1)

    for _ in range(rounds):
        at = [near(p)[0] for p in range(4)]
        for p in range(4):
            for e in range(len(books[p])):
                mine = x[at[p] == e, p]
                if len(mine):
                    books[p, e] = mine.sum(0) // len(mine)
    found = [near(p) for p in range(4)]
    codes = ["".join(f"{found[p][0][k]:02x}" for p in range(4)) for k in range(len(kept))]
    errors = [int(sum(found[p][1][k] for p in range(4))) for k in range(len(kept))]
    sums = {}
    for (_, _, label), e in zip(kept, errors, strict=True):
        sums[label] = sums.get(label, 0) + e
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return [(d, c, e, sums[label], digest) for (d, _, label), c, e in zip(kept, codes, errors, strict=True)]


def key(row):
    return (row[0] is None, row[0] or 0, *row[1:])


def vector_rows(n, dims, seed):
    rng = np.random.default_rng(seed)
    centre = rng.normal(0, 0.2, (7, dims))
    v = np.round(centre[rng.integers(0, 7, n)] + rng.normal(0, 0.05, (n, dims)), 2)
    rows = [(int(k), v[k].tolist(), int(k) % 3 if k % 5 else None) for k in rng.permutation(n)]
    odd = [(3, None, 1), (4, [0.0] * (dims - 1) + [None], 1), (5, [float("nan")] * dims, 2), (6, [float("inf")] + [0.0] * (dims - 1), 2)]
    return [*rows, *odd, rows[0], rows[0], (None, v[1].tolist(), None), (None, v[2].tolist(), 9), (7, [0.0] * dims, None)]


@pytest.mark.parametrize(("n", "dims", "entries"), [(400, 16, 256), (300, 8, 16), (20, 8, 256)])
def test_vector_codes_equal_brute_force(spark, monkeypatch, n, dims, entries):
    rows = vector_rows(n, dims, n)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, code string, v int").repartition(6)
    out = vc.compress(df, entries=entries).collect()
    got = sorted([(r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in out], key=key)
    assert got == sorted(brute_codes(rows, entries), key=key)


def test_undominated_entries_hold_every_nearest_one(monkeypatch):
    monkeypatch.setattr(vc, "CELLS", 8)
    rng = np.random.default_rng(1)
    book = rng.integers(-90, 90, (40, 3))
    book[7] = book[21]
    x = rng.integers(-120, 120, (3000, 3))
    d = ((x[:, None] - book) ** 2).sum(-1)
    for side in (1, 5, 40, 1000):
        cells = vc.Cells(book)
        cells.side = side
        for lo in range(0, 3000, 500):
            index, best = cells.nearest(x[lo : lo + 500])
            assert (index == d[lo : lo + 500].argmin(1)).all() and (best == d[lo : lo + 500].min(1)).all()


def test_codes_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>, label string"
    empty = spark.createDataFrame([], schema)
    assert vc.compress(empty).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and vc.compress(empty).count() == 0
    one = spark.createDataFrame([(5, [0.5, -0.5, 0.0001, -0.0001], "a")], schema)
    row = vc.compress(one).first()
    assert (row.code, row.error, row.codebooks_sha256) == ("00000000", 0, hashlib.sha256(b"512,-512,0,-1").hexdigest())
    uneven = spark.createDataFrame([(1, [0.1] * 8, "a"), (2, [0.1] * 4, "a")], schema)
    with pytest.raises(Exception, match="length"):
        vc.compress(uneven).count()
    with pytest.raises(Exception, match="larger"):
        vc.compress(spark.createDataFrame([(1, [1e9] * 4, "a")], schema)).count()


def test_all_thirteen_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(any(k.startswith(f"op{n}_") for k in names) for n in range(1, 14))
