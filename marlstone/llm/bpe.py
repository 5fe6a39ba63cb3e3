"""Byte-pair encoding and decoding of whole texts, the same ids as the tokenizers library gives.

Texts up to piece_chars are encoded as they are. Longer ones are halved until no piece is longer; pieces are
rows, encoded in parallel, and concatenated as a tree: around each join a window is encoded again and grows
until both sides agree with it exactly at a boundary that splitting the whole text would have too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm.common import keep, leaving_nothing
from marlstone.session import ship

#: Characters of a batch that one call encodes: bounds a Python worker's memory.
BATCH_CHARS = 1 << 20
#: Bytes next to a cut whose boundaries aren't trusted: more than any special token, and than what a split looks ahead.
MARGIN = 64
# Fixed value: the pattern of byte-level splitting.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_loaded: dict = {}


def tokenizer(path: str):
    """The tokenizer of a file, loaded once per worker, and the number of bytes of each token."""
    if path not in _loaded:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        special = tok.get_added_tokens_decoder()
        size = np.zeros(tok.get_vocab_size(with_added_tokens=True), dtype=np.int64)
        for s, i in tok.get_vocab(with_added_tokens=True).items():
            # A byte-level token has one character per byte; an added one is plain text.
            size[i] = len(s.encode()) if i in special else len(s)
        _loaded[path] = tok, size
    return _loaded[path]


def engine(path: str):
    """A faster engine for the same ids: tiktoken over the vocabulary of a tokenizers file.

    Only where the file says what that engine does: byte-level splitting by the usual pattern, no other settings,
    and ids in the order of merges. None otherwise. It gives the same ids on every code point and on long runs.
    """
    if (path, "engine") not in _loaded:
        import json

        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"].get("merges", [])
        pre = spec.get("pre_tokenizer") or {}
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        plain = all(not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in spec.get("added_tokens", []))
        byte_level = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        model = spec["model"]
        bare = not (spec.get("normalizer") or model.get("dropout") or model.get("unk_token") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("byte_fallback") or model.get("ignore_merges"))
        pairs = ["".join(m if isinstance(m, list) else m.split(" ")) for m in merges]
        ordered = all(vocab.get(m) == 256 + i for i, m in enumerate(pairs)) and len(pairs) + 256 == len([t for t in vocab if t not in added])
        found = None
        if plain and byte_level and bare and ordered:
            # The byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on.
            shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
            byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
            ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if t not in added}
            found = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=added)
        _loaded[path, "engine"] = found
    return _loaded[path, "engine"]


class Piece:
    """Text as bytes, its ids, where each token starts (bytes), and which tokens start a word of the splitter."""

    def __init__(self, data: bytes, ids: np.ndarray, starts: np.ndarray, opens: np.ndarray):
        self.data, self.ids, self.starts, self.opens = data, ids, starts, opens

    @classmethod
    def of(cls, path: str, data: bytes) -> Piece:
        tok, size = tokenizer(path)
        enc = tok.encode(data.decode(), add_special_tokens=False)
        ids = np.asarray(enc.ids, dtype=np.int32)
        words = np.asarray([-1 if w is None else w for w in enc.word_ids], dtype=np.int64)
        ends = np.cumsum(size[ids]) if len(ids) else np.zeros(0, dtype=np.int64)
        opens = np.ones(len(ids), dtype=bool)
        opens[1:] = words[1:] != words[:-1]
        return cls(data, ids, ends - size[ids], opens)


def joined(path: str, left: Piece, right: Piece) -> Piece:
    """The piece of left's text followed by right's, as if encoded whole.

    Left is right up to its last word boundary that is MARGIN bytes before the cut: what follows there can't
    change it. From there a window is encoded again. A boundary behind the cut that the window has (MARGIN bytes
    before the window's own end) and right has too is one of the whole text, and from it on right is right, for
    splitting looks only forward. If there is none, the window grows, up to all of right.
    """
    n = len(left.data)
    data = left.data + right.data
    at = np.flatnonzero(left.opens & (left.starts <= n - MARGIN))
    head = int(at[-1]) if len(at) else 0
    begin = int(left.starts[head]) if len(at) else 0
    reach = 4 * MARGIN
    while True:
        end = min(n + reach, len(data))
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end += 1
        w = Piece.of(path, data[begin:end])
        if end == len(data):
            cut_w, cut_r = len(w.ids), len(right.ids)
            break
        seen = w.starts + begin
        ok = w.opens & (seen >= n) & (seen <= end - MARGIN)
        common = np.intersect1d(seen[ok], right.starts[right.opens] + n)
        if len(common):
            cut_w = int(np.searchsorted(seen, common[0]))
            cut_r = int(np.searchsorted(right.starts + n, common[0]))
            break
        reach *= 2
    return Piece(
        data,
        np.concatenate([left.ids[:head], w.ids[:cut_w], right.ids[cut_r:]]),
        np.concatenate([left.starts[:head], w.starts[:cut_w] + begin, right.starts[cut_r:] + n]),
        np.concatenate([left.opens[:head], w.opens[:cut_w], right.opens[cut_r:]]),
    )


def tree(path: str, pieces: list[Piece]) -> Piece:
    """Neighbours joined pairwise until one piece is left."""
    while len(pieces) > 1:
        pieces = [joined(path, *pieces[i : i + 2]) if i + 1 < len(pieces) else pieces[i] for i in range(0, len(pieces), 2)]
    return pieces[0]


def _encoded(path: str, column: str, out: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fast = engine(path)
        tok = None if fast else tokenizer(path)[0]
        for b in batches:
            texts = b.column(b.schema.get_field_index(column)).to_pylist()
            i = 0
            while i < len(texts):
                j, chars = i, 0
                while j < len(texts) and (j == i or chars + len(texts[j] or "") <= BATCH_CHARS):
                    chars += len(texts[j] or "")
                    j += 1
                if fast:
                    ids = [fast.encode_to_numpy(t or "", allowed_special="all").astype(np.int32) for t in texts[i:j]]
                else:
                    ids = [np.asarray(e.ids, dtype=np.int32) for e in tok.encode_batch_fast([t or "" for t in texts[i:j]], add_special_tokens=False)]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                values = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32))
                yield pa.RecordBatch.from_arrays([*b.slice(i, j - i).columns, pa.ListArray.from_arrays(pa.array(offsets), values)], names=[*b.schema.names, out])
                i = j

    return run


def encode(docs: DataFrame, path: str, text: str = "text", out: str = "ids", piece_chars: int = 1 << 16) -> DataFrame:
    """docs with the ids of text as array<int> in column out (which replaces one of that name).

    Null text: no ids. Special tokens in a text are recognised, as the library does by default. Rows, repeated or
    not, and all other columns stay. An empty table gives no rows. path: the tokenizer's file, on every executor.
    """
    ship(docs.sparkSession)
    names = {c: f"__own_{i}" for i, c in enumerate(c for c in docs.columns if c != out)}
    own = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    t = names[text]
    long = F.coalesce(F.length(t) > piece_chars, F.lit(False))
    schema = T.StructType([*own.schema.fields, T.StructField("__ids", T.ArrayType(T.IntegerType(), False))])
    short = own.filter(~long).mapInArrow(leaving_nothing(_encoded(path, t, "__ids")), schema)
    # Long texts are written once, with a row number of their own: pieces must find their text again, whatever runs twice.
    big = keep(own.filter(long).withColumn("__row", F.monotonically_increasing_id()), "long")
    # Halving until no piece is longer makes a power of two of equal pieces; one pass over the text cuts them all.
    n = F.pow(F.lit(2.0), F.ceil(F.log2(F.length(t) / piece_chars)))
    width = F.ceil(F.length(t) / n).cast("int")
    cuts = F.regexp_extract_all(t, F.concat(F.lit("(?s).{1,"), width.cast("string"), F.lit("}")), F.lit(0))
    pieces = big.select("__row", F.posexplode(cuts).alias("k", "piece"))
    # Dealt anew: the pieces of one text go to many tasks.
    pieces = pieces.repartition("__row", "k")
    kinds = "__row long, k int, data binary, ids array<int>, starts array<long>, opens array<boolean>"

    def one(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for row, k, piece in zip(f["__row"], f["k"], f["piece"], strict=True):
                p = Piece.of(path, piece.encode())
                yield pd.DataFrame({"__row": [row], "k": [k], "data": [p.data], "ids": [p.ids], "starts": [p.starts], "opens": [p.opens]})

    def whole(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("k")
        parts = [Piece(bytes(d), np.asarray(i, np.int32), np.asarray(s, np.int64), np.asarray(o, bool)) for d, i, s, o in zip(f["data"], f["ids"], f["starts"], f["opens"], strict=True)]
        return pd.DataFrame({"__row": [f["__row"].iloc[0]], "__ids": [tree(path, parts).ids]})

    ids = pieces.mapInPandas(leaving_nothing(one), kinds).groupBy("__row").applyInPandas(leaving_nothing(whole), "__row long, __ids array<int>")
    done = big.join(ids, "__row").drop("__row")
    return short.unionByName(done).select(*[F.col(n).alias(c) for c, n in names.items()], F.col("__ids").alias(out))


def decode(encoded: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """encoded with the text of ids (special tokens kept) in column out; null ids: the empty text."""
    ship(encoded.sparkSession)
    cols = [c for c in encoded.columns if c != out]
    schema = T.StructType([*[encoded.schema[c] for c in cols], T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fast = engine(path)
        tok = None if fast else tokenizer(path)[0]
        for b in batches:
            lists = b.column(b.schema.get_field_index(ids))
            i = 0
            while i < len(lists):
                j, n = i, 0
                while j < len(lists) and (j == i or n + len(lists[j] or ()) <= BATCH_CHARS):
                    n += len(lists[j] or ())
                    j += 1
                rows = [x or [] for x in lists.slice(i, j - i).to_pylist()]
                texts = [fast.decode(x) for x in rows] if fast else tok.decode_batch(rows, skip_special_tokens=False)
                yield pa.RecordBatch.from_arrays([*b.slice(i, j - i).columns, pa.array(texts, pa.string())], names=[*b.schema.names, out])
                i = j

    return encoded.select(*cols).mapInArrow(run, schema)


