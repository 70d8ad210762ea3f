"""Encoding and decoding with a merge-type sentence-piece vocabulary.

Encoding is exact without a merge queue: an Aho-Corasick automaton finds the longest vocabulary match at each
position in one pass; a match is taken if it may stand beside the token before it, which it may if merging
the joined characters of both anew gives back just these two. Where no match fits, the last token is taken
back for a shorter one, and a bitfield remembers the positions from which no encoding goes on. No piece of
such a vocabulary holds a word mark after another character, so a text is encoded in chunks (word marks and
what follows up to the next one), which are kept in a bounded table, as are the pairs that were checked.

Defined cases: a null or empty text is the end id alone and decodes to the empty text; characters out of
the vocabulary become byte pieces; repeated rows are encoded as often as they come; other columns stay
as they are.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

MARK = "▁"
CACHE_ENTRIES = 300_000
PAIR_ENTRIES = 2_000_000
_models: dict[str, PieceModel] = {}


class PieceModel:
    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        self.end_id = sp.eos_id()
        self.text = [sp.id_to_piece(i) for i in range(n)]
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.text) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.silent = {i for i in range(n) if sp.is_control(i)}
        self.unknown = sp.unk_id()
        usable = [i for i in range(n) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i) or sp.is_unused(i))]
        #: A piece merges the earlier, the higher its score; ids break no ties as scores differ.
        self.rank = {self.text[i]: -sp.get_score(i) for i in usable}
        self.id_of = {self.text[i]: i for i in usable}
        self.chars = {p for p in self.id_of if len(p) == 1}
        self.pairs: dict[int, bool] = {}
        self.kept: dict[str, bytes] = {}
        # pieces that merging their characters gives back; others never come out of it
        self.name = [p for p in self.id_of if self.merged(p) == [p]]
        self.at = {p: k for k, p in enumerate(self.name)}
        self.size = [len(p) for p in self.name]
        self.id = [self.id_of[p] for p in self.name]
        self.matcher = ahocorasick.Automaton()
        for p, k in self.at.items():
            self.matcher.add_word(p, k)
        self.matcher.make_automaton()
        # the next shorter piece that begins a piece
        self.shorter = [next((self.at[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in self.at), -1) for p in self.name]

    def merged(self, text: str) -> list[str]:
        """Characters merged by rank, leftmost first, until nothing merges."""
        now, rank = list(text), self.rank
        while len(now) > 1:
            ranks = [rank.get(x + y, np.inf) for x, y in pairwise(now)]
            least = min(ranks)
            if least == np.inf:
                break
            at = ranks.index(least)
            now[at : at + 2] = [now[at] + now[at + 1]]
        return now

    def fits(self, a: int, b: int) -> bool:
        """Whether a and b stay apart when their characters are merged anew."""
        x, y = self.name[a], self.name[b]
        return self.merged(x + y) == [x, y]

    def split(self, text: str) -> list[int]:
        """Tokens of a text of known characters, by backtracking."""
        n, size, shorter, pairs, width = len(text), self.size, self.shorter, self.pairs, len(self.name)
        longest = [-1] * n
        for end, k in self.matcher.iter(text):  # of the matches that begin at a place, the longest comes last
            longest[end + 1 - size[k]] = k
        failed = bytearray((n >> 3) + 1)  # a bit for each position from which no encoding goes on
        out: list[int] = []
        at, last = 0, -1
        i = longest[0]
        while True:
            while i >= 0:
                end = at + size[i]
                if not failed[end >> 3] >> (end & 7) & 1:
                    if last < 0:
                        break
                    known = pairs.get(last * width + i)
                    if known is None:
                        if len(pairs) > PAIR_ENTRIES:
                            pairs.clear()
                        known = pairs[last * width + i] = self.fits(last, i)
                    if known:
                        break
                i = shorter[i]
            if i >= 0:
                out.append(i)
                at += size[i]
                if at == n:
                    return out
                last = i
                i = longest[at]
            else:
                failed[at >> 3] |= 1 << (at & 7)
                if not out:
                    raise ValueError(f"no encoding of {text!r}")
                i = out.pop()
                at -= size[i]
                i = shorter[i]
                last = out[-1] if out else -1

    def chunk(self, text: str) -> list[int]:
        if self.chars.issuperset(text):
            return [self.id[k] for k in self.split(text)]
        ids: list[int] = []
        run = 0
        for i, c in enumerate(text):
            if c not in self.chars:
                if run < i:
                    ids += [self.id[k] for k in self.split(text[run:i])]
                ids += [self.bytes.get(b, self.unknown) for b in c.encode()]
                run = i + 1
        return ids + [self.id[k] for k in self.split(text[run:])] if run < len(text) else ids

    def coded(self, chunk: str) -> bytes:
        if self.chars.issuperset(chunk):
            return array("i", [self.id[k] for k in self.split(chunk)]).tobytes()
        return array("i", self.chunk(chunk)).tobytes()

    def encode(self, text: str | None) -> np.ndarray:
        """Ids as 32-bit integers, the end id last."""
        end = np.array([self.end_id], "i4")
        if not text:
            return end
        kept = self.kept
        marked = text.replace(" ", MARK)
        if MARK * 2 in marked or marked[0] == MARK:
            chunks = re.findall(f"{MARK}+[^{MARK}]*", MARK + marked)
            chunks = [x[1:] for x in chunks]  # each has a mark in front, left out of the table
        else:
            chunks = marked.split(MARK)
        new = {c for c in chunks if c not in kept}
        for c in new:
            kept[c] = self.coded(MARK + c)
        ids = b"".join(map(kept.__getitem__, chunks))
        if len(kept) > CACHE_ENTRIES:
            kept.clear()
        for c in new:
            if len(c) > 40:  # long ones seldom come again
                kept.pop(c, None)
        return np.concatenate([np.frombuffer(ids, "i4"), end])

    def decode(self, ids: list[int] | None) -> str:
        """What the ids stand for: word marks as spaces, without the one in front; bytes that are no UTF-8 as U+FFFD."""
        if not ids:
            return ""
        byte_of, text = self.byte_of, self.text
        if byte_of.keys().isdisjoint(ids):
            out = "".join([text[i] for i in ids if i not in self.silent])
        else:
            parts: list[str] = []
            run = bytearray()
            for i in [*ids, -1]:
                if i in byte_of:
                    run.append(byte_of[i])
                    continue
                while run:
                    try:
                        parts.append(run.decode())
                        run.clear()
                    except UnicodeDecodeError as e:
                        parts.append(run[: e.start].decode() + "�")
                        del run[: e.start + 1]
                if i >= 0 and i not in self.silent:
                    parts.append(text[i])
            out = "".join(parts)
        return out.removeprefix(MARK).replace(MARK, " ")


def model(path: str) -> PieceModel:
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def encoded(text: Column, path: str) -> Column:
    """array<int>: the ids of each text, the end id last."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield ragged([model(path).encode(t) for t in b.to_pylist()])

    return F.arrow_udf(run, "array<int>")(text)


def decoded(ids: Column, path: str) -> Column:
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array([model(path).decode(x.values.to_pylist()) if x.is_valid else "" for x in b], pa.string())

    return F.arrow_udf(run, "string")(ids)


def round_trip(text: Column, path: str) -> Column:
    """struct<ids, decoded>: encoded() and decoded() of its ids, without the way there and back."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = model(path)
        for b in batches:
            ids = [m.encode(t) for t in b.to_pylist()]
            yield pa.StructArray.from_arrays([ragged(ids), pa.array([m.decode(x.tolist()) for x in ids], pa.string())], ["ids", "decoded"])

    return F.arrow_udf(run, "struct<ids: array<int>, decoded: string>")(text)


def ragged(rows: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, rows)]).astype("i4")
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, "i4"), *rows])))
