"""Concatenate and cut: documents laid end to end, cut into fixed windows.

Pass one tokenizes every document once and sums the tokens of each partition; prefix sums over those
totals give each document its global offset. Pass two cuts the stream at multiples of the window; a
document that crosses a cut leaves one piece (boundary record) on each side. All windows but the last
are full. Token ids are never shuffled.

Defined cases: a null or empty text is the end id alone; an empty table gives no pieces; repeated rows
are packed as often as they come; other columns of the input are not read.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, model, prefix_sums

CACHE_ENTRIES = 300_000


class WordTokenizer:
    """A tokenizer, and the same vocabulary as ranks for the texts that can go by chunks.

    The byte-level pattern's pre-tokens never cross a space that follows a non-space, so chunks up to such a
    space are encoded apart and kept in a bounded table. Texts with a special token, and all texts of a
    tokenizer with another pattern or a normalizer, go through the tokenizer whole."""

    def __init__(self, json_path: str, rank_path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(rank_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ranked = tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.full = Tokenizer.from_file(json_path)
        made = json.loads(self.full.to_str())
        before = made.get("pre_tokenizer") or {}
        self.by_chunks = made.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex") is True and before.get("add_prefix_space") is False
        self.special = [t.content for t in self.full.get_added_tokens_decoder().values()]
        self.kept: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if not self.by_chunks or any(s in text for s in self.special):
            return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        kept = self.kept
        if re.search(r"\s ", text):
            chunks = re.split(r"(?<=\S)(?= )", text)
        else:
            first, *rest = text.split(" ")
            chunks = [first, *map(" ".__add__, rest)]
        try:
            return b"".join(map(kept.__getitem__, chunks))
        except KeyError:
            if len(kept) > CACHE_ENTRIES:
                kept.clear()
            for c in chunks:
                if c not in kept:
                    ids = np.array(self.ranked.encode_ordinary(c), "<u4").tobytes()
                    if len(c) > 40:  # long ones seldom come again
                        return b"".join(kept[x] if x in kept else np.array(self.ranked.encode_ordinary(x), "<u4").tobytes() for x in chunks)
                    kept[c] = ids
            return b"".join(map(kept.__getitem__, chunks))


def tokenizer(json_path: str, rank_path: str) -> WordTokenizer:
    return model(("packing", json_path, rank_path), lambda: WordTokenizer(json_path, rank_path))


def pack(docs: DataFrame, json_path: str, rank_path: str, key: str = "doc_id", text: str = "text", window: int = 1024, end_id: int = 0) -> DataFrame:
    """Pieces: key, start, length, doc_tokens, sequence_id, offset, ids (binary, little-endian unsigned 32-bit).

    json_path: a tokenizer of the tokenizers library; rank_path: the same vocabulary as ranks."""
    kind = docs.schema[key].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, at, part = tokenizer(json_path, rank_path), 0, TaskContext.get().partitionId()
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                some = b.slice(lo, 512)
                ids = [(tok.encode(t) if t else b"") + end for t in some.column(1).to_pylist()]
                n = np.array([len(x) // 4 for x in ids], "i8")
                starts = at + np.cumsum(n) - n
                at += int(n.sum())
                small = [np.frombuffer(x, "<u4") for x in ids]
                packed = [x.astype("<u2").tobytes() if x.max() < 65536 else y for x, y in zip(small, ids, strict=True)]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(np.full(len(ids), part, "i4")), pa.array(starts), pa.array(n), pa.array(packed, pa.binary())], names=[key, "part", "start", "n", "ids"])

    tokens = checkpointed(docs.select(key, text).mapInArrow(count, f"`{key}` {kind}, part int, start long, n long, ids binary"))
    totals = prefix_sums(tokens.groupBy("part").agg(F.sum("n").alias("total")), "part", "total", "before")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                some = b.slice(lo, 512)
                rows: list[tuple[int, int, int, int, int, int, bytes]] = []
                for i, (at, n, ids) in enumerate(zip(*(some.column(k).to_pylist() for k in (1, 2, 3)), strict=True)):
                    wide = np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4").astype("<u4")
                    done = 0
                    while done < n:
                        seq, off = divmod(at + done, window)
                        k = min(window - off, n - done)
                        rows.append((i, done, k, n, seq, off, wide[done : done + k].tobytes()))
                        done += k
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(cols[0], pa.int64())), *(pa.array(c, pa.int64()) for c in cols[1:6]), pa.array(cols[6], pa.binary())], names=[key, "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    placed = tokens.join(F.broadcast(totals.select("part", "before")), "part")  # a row per partition
    return placed.select(key, (F.col("before") + F.col("start")).alias("at"), "n", "ids").mapInArrow(cut, f"`{key}` {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
