"""Token counts of whole texts, by batch encoding; only lengths come back.

An Arrow function cuts what it is given into lots of about equal bytes and encodes a lot at a time, so memory
and time of a lot don't depend on how rows are spread. A text longer than a piece is cut where its tokenizer
can be shown to begin a new token whatever stands before, and its pieces are counted apart:

* byte-level pattern without a normalizer: before a space or line break that follows a letter, digit or
  underscore (a run of white space begins a token of its own or is taken into the next one);
* sentence pieces without a normalizer, if no piece has a word mark after another character: at a space after
  such a character; the space is left out, as the library puts one in front of each piece.

Other tokenizers, and stretches without such a place, are encoded whole.

Defined cases: a null or empty text has no token; strings of special tokens inside a text count as the
library's default has it; no truncation, padding, begin or end; repeated rows are counted as often as they
come; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

LOT_BYTES = 1 << 18
PIECE_CHARS = 1 << 14
MARK = "▁"
_counters: dict[str, TokenCounter] = {}


class TokenCounter:
    def __init__(self, path: str):
        #: where a text may be cut; None: nowhere
        self.place: re.Pattern[str] | None = None
        #: whether the character at the cut is left out
        self.drops = False
        self.lengths: Callable[[list[str]], list[int]] = self.of_pieces(path) if path.endswith(".model") else self.of_words(path)

    def of_words(self, path: str) -> Callable[[list[str]], list[int]]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        made = json.loads(tok.to_str())
        before = made.get("pre_tokenizer") or {}
        plain = made.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex") is True and before.get("add_prefix_space") is False
        added = made.get("added_tokens") or []
        if plain and not any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            self.place = re.compile(r"(?<=\w)[ \n]")
        return lambda texts: [len(e) for e in tok.encode_batch_fast(texts, add_special_tokens=False)]

    def of_pieces(self, path: str) -> Callable[[list[str]], list[int]]:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        as_it_is = sp.normalize("  ﬁ① Ａ\t  ") == f"{MARK * 3}ﬁ①{MARK}Ａ\t{MARK * 2}"
        if as_it_is and not any(MARK in sp.id_to_piece(i).lstrip(MARK) for i in range(sp.vocab_size())):
            self.place, self.drops = re.compile(r"(?<=\w) (?=.)", re.DOTALL), True
        return lambda texts: list(map(len, sp.encode(texts, num_threads=1)))

    def pieces(self, text: str, chars: int = PIECE_CHARS) -> list[str]:
        """The text in pieces of chars and what follows up to the next safe place."""
        if self.place is None or len(text) <= chars:
            return [text]
        out, at = [], 0
        while len(text) - at > chars and (m := self.place.search(text, at + chars)):
            out.append(text[at : m.start()])
            at = m.end() if self.drops else m.start()
        return [*out, text[at:]]

    def count(self, texts: pa.Array, chars: int = PIECE_CHARS, lot_bytes: int = LOT_BYTES) -> np.ndarray:
        total = np.zeros(len(texts), "i8")
        lot: list[str] = []
        owners: list[int] = []
        held = 0

        def done() -> None:
            np.add.at(total, owners, self.lengths(lot))
            lot.clear()
            owners.clear()

        for i, (text, size) in enumerate(zip(texts.to_pylist(), pc.binary_length(texts).to_pylist(), strict=True)):
            if not text:
                continue
            for piece in self.pieces(text, chars):
                lot.append(piece)
                owners.append(i)
                held += size if len(piece) == len(text) else len(piece.encode())
                if held >= lot_bytes:
                    done()
                    held = 0
        if lot:
            done()
        return total


def counter(path: str) -> TokenCounter:
    if path not in _counters:
        _counters[path] = TokenCounter(path)
    return _counters[path]


def counted(text: Column, path: str) -> Column:
    """Tokens of each text (long); path: a .json of the tokenizers library or a .model of sentencepiece."""
    if not path.endswith((".json", ".model")):
        raise ValueError(f"neither .json nor .model: {path}")

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array(counter(path).count(b), pa.int64())

    return F.arrow_udf(run, "long")(text)
