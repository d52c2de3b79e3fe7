"""Token counts per text.

Texts are cut where cutting cannot change a token: for the word vocabulary at
white space, which its normaliser drops; for the byte vocabulary before a single
space and around a single line break between two printing characters, where its
pattern always starts a piece.
Such pieces repeat, so each Arrow batch encodes only pieces that are not yet in
the worker's bounded memory, in groups balanced by bytes, and adds up lengths.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces in each of the two generations that a worker remembers.
MEMORY = 500_000
#: Marks that may be cut off the end of a word.
MARKS = ".,;:!?|"
#: Bytes handed to the tokenizer at once.
GROUP_BYTES = 256_000
#: A longer piece than this is not remembered.
LONG_PIECE = 64

_workers: dict = {}


class Encoder:
    """A tokenizer with a bounded memory of pieces; one for each vocabulary and worker."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.safe = None
            self.encode = lambda texts: model.encode(texts, num_threads=1)
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            self.safe = safe_cut(model)
            if self.safe is BeforeSpaces:
                self.encode = joined(model)
            else:
                self.encode = lambda texts: [e.ids for e in model.encode_batch_fast(texts, add_special_tokens=False)]
        self.young: dict = {}
        self.old: dict = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in _workers:
            _workers[path] = cls(path)
        return _workers[path]

    def pieces(self, texts: pa.Array) -> pa.ListArray:
        """Every text cut at its safe boundaries, without NULLs; pieces of white space alone may be left out."""
        texts = pc.fill_null(texts, "")
        if self.safe is None:
            return pa.ListArray.from_arrays(np.arange(len(texts) + 1, dtype=np.int32), texts)
        odd = pc.match_substring_regex(texts, self.safe.odd)
        rows = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        plain = self.safe.plain(texts.filter(pc.invert(odd)) if len(rows) else texts)
        if not len(rows):
            return plain
        slow = pa.array([self.safe.odd_text(t) for t in texts.take(pa.array(rows)).to_pylist()], plain.type)
        place = np.empty(len(texts), np.int64)
        place[rows] = len(plain) + np.arange(len(rows))
        place[np.setdiff1d(np.arange(len(texts)), rows)] = np.arange(len(plain))
        return pa.concat_arrays([plain, slow]).take(pa.array(place))

    def values(self, texts: pa.Array, keep) -> tuple[list, np.ndarray, np.ndarray]:
        """Values of the distinct pieces, the number of each piece in order, and where each text's pieces begin."""
        lists = self.pieces(texts)
        offsets = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        return self.learn(coded.dictionary.to_pylist(), keep), coded.indices.to_numpy(), offsets - offsets[0]

    def learn(self, pieces: list[str], keep) -> list:
        """Values of ``keep(ids)`` for distinct pieces, from memory or encoded now; values must add up as ids do.

        The memory has two generations: a full young one becomes the old one, and
        what is still used comes back from there.
        """
        young, old, known = self.young, self.old, {}
        out = list(map(young.get, pieces))
        missing = [k for k, value in enumerate(out) if value is None]
        new, marked = {}, []
        for k in missing:
            p = pieces[k]
            value = old.get(p)
            if value is not None:
                out[k] = young[p] = value
            # Both patterns end a run of letters before such a mark; lower case
            # must not put a mark behind the letter.
            elif self.safe and len(p) > 1 and p[-1] in MARKS and p[-2].lower()[-1:].isalpha():
                marked.append(k)
                new[p[:-1]] = new[p[-1]] = None
            else:
                new[p] = None
        group, held, todo = [], 0, len(new)
        for p in new:
            todo -= 1
            value = young.get(p)
            if value is not None:
                known[p] = value
            else:
                group.append(p)
                held += len(p)
            if group and (held >= GROUP_BYTES or not todo):
                for q, ids in zip(group, self.encode(group), strict=True):
                    value = known[q] = keep(ids)
                    if len(q) <= LONG_PIECE:
                        young[q] = value
                group, held = [], 0
        for k in marked:
            p = pieces[k]
            out[k] = known[p[:-1]] + known[p[-1]]
            if len(p) <= LONG_PIECE:
                young[p] = out[k]
        for k in missing:
            if out[k] is None:
                out[k] = known[pieces[k]]
        if len(young) > MEMORY:
            self.young, self.old = {}, young
        return out


def joined(model):
    """Encoder of lists of pieces for a byte-level vocabulary.

    Pieces that begin with a lone space and end in a printing character can stand
    behind each other, so they are encoded as one text. A token stands for as
    many bytes as its name has characters, which tells where a piece ends.
    """
    size = np.zeros(model.get_vocab_size(with_added_tokens=True), np.int64)
    for name, k in model.get_vocab(with_added_tokens=True).items():
        size[k] = len(name)

    def encode(pieces):
        out = [None] * len(pieces)
        row = [k for k, p in enumerate(pieces) if len(p) > 1 and p[0] == " " and not p[1].isspace() and not p[-1].isspace()]
        if row:
            ids = np.array(model.encode_batch_fast(["".join([pieces[k] for k in row])], add_special_tokens=False)[0].ids)
            ends = np.cumsum([len(pieces[k].encode()) for k in row])
            cuts = np.searchsorted(np.cumsum(size[ids]), ends).tolist()
            ids, last = ids.tolist(), 0
            for k, cut in zip(row, cuts, strict=True):
                out[k], last = ids[last : cut + 1], cut + 1
        rest = [k for k, x in enumerate(out) if x is None]
        for k, e in zip(rest, model.encode_batch_fast([pieces[k] for k in rest], add_special_tokens=False), strict=True):
            out[k] = e.ids
        return out

    return encode


def safe_cut(tokenizer):
    """How to cut texts for this tokenizer, from its own description.

    A cut is only made where the description shows that it is safe; for any
    other kind of tokenizer the whole text is one piece.
    """
    import json

    about = json.loads(tokenizer.to_str())
    added = about.get("added_tokens") or []
    if any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added):
        return None
    pre = about.get("pre_tokenizer") or {}
    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not about.get("normalizer"):
        return BeforeSpaces
    kinds = [p.get("type") for p in pre.get("pretokenizers", [])]
    split = pre.get("pretokenizers", [{}])[0] if kinds[:1] == ["Split"] else {}
    if split.get("behavior") == "Removed" and split.get("invert") and r"[^\s\p{L}\p{N}]+" in split.get("pattern", {}).get("Regex", ""):
        return AtSpaces
    return None


class BeforeSpaces:
    """Cuts for the byte-level pattern. It takes " ?" with what follows, so a lone
    space between two printing characters always opens a piece, and a lone line
    break there is a piece of its own."""

    #: Other white space, white space beside white space or at an end, or the mark used for cutting.
    odd = "[\x01\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]|[ \n][ \n]|\\A[ \n]|[ \n]\\z"
    _lone = re.compile(r"(?<=\S)(?= \S)")

    @classmethod
    def plain(cls, texts):
        marked = pc.replace_substring(pc.replace_substring(texts, " ", "\x01 "), "\n", "\x01\n\x01")
        return pc.split_pattern(marked, "\x01")

    @classmethod
    def odd_text(cls, text):
        return cls._lone.split(text)


class AtSpaces:
    """Cuts for a vocabulary that drops white space."""

    #: White space to str.split, a printing character to the tokenizers library; other
    #: white space than plain spaces and line breaks is left to str.split.
    odd = "[\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
    _separators = re.compile("[\x1c-\x1f]")

    @classmethod
    def plain(cls, texts):
        return pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")

    @classmethod
    def odd_text(cls, text):
        return [text] if cls._separators.search(text) else text.split()


def batches_by_bytes(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of about ``most`` bytes of the text column, a row at least."""
    start, held = 0, 0
    for k, n in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
        if k > start and held + (n or 0) > most:
            yield batch.slice(start, k - start)
            start, held = k, 0
        held += n or 0
    if start < batch.num_rows:
        yield batch.slice(start)


def count_tokens(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, batch_bytes: int = 16_000_000
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row of ``docs``.

    NULL and empty texts have 0 bytes and 0 tokens; a NULL id stays NULL; rows
    that repeat are counted each; other columns are not read; an empty table
    gives an empty one. ``path`` names a tokenizers (.json) or sentencepiece
    (.model) file that every executor can open. Special strings inside a text
    are treated as the library does by default.
    """

    def run(batches):
        encoder = Encoder.of(path)
        for whole in batches:
            for batch in batches_by_bytes(whole, 1, batch_bytes):
                values, index, at = encoder.values(batch.column(1), len)
                total = np.concatenate([[0], np.cumsum(np.array(values or [0], np.int64)[index])])
                counts = total[at[1:]] - total[at[:-1]]
                sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(counts, pa.int64())], ["id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(run, "id long, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import table

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
