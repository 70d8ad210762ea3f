"""Language identification, words first.

A word seen often enough in training scores by its log frequency in each language; an unseen one falls
back to its character n-grams, the longest order first of which any is known, over its whole length. A
document's score per language is the sum over its words (with the languages' shares), its probability a
softmax of that sum; it isn't calibrated, and near 1 for all but short or mixed texts.

The model is fitted on a bounded sample of labelled rows (``sample_rows``, dealt by a hash of the id) and
holds ``entries`` words and as many n-grams of each order; every language has an equal part of them, its
most frequent ones (of those that are equally frequent, all or none; words met once in the sample aren't kept).

Defined cases: a text that is null or has no letter (digits, fractions and marks are none) is ``und`` with score 0; with nothing to learn from,
every text is ``und``; a tie goes to the smaller language name; rows without an id aren't learned from;
repeated rows score alike; other columns are not read.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Callable, Iterator
from itertools import chain, groupby
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed
from .common import model as held

#: A word is a letter and the letters and marks that follow it, when learning (JVM) and when scoring (Python).
WORD = r"(\p{L}[\p{L}\p{M}]*)"


def code_points(wanted: Callable[[str], bool]) -> list[str]:
    """The assigned characters of the wanted general categories."""
    return [c for c in map(chr, chain(range(0x40000), range(0xE0000, 0xE1000))) if wanted(unicodedata.category(c))]


def character_class(wanted: Callable[[str], bool]) -> str:
    runs = groupby(enumerate(code_points(wanted)), lambda x: ord(x[1]) - x[0])
    return "".join(f"{c[0]}-{c[-1]}" for _, run in runs for c in [[x for _, x in run]])


LETTERS = re.compile(f"[{character_class(lambda k: k[0] == 'L')}][{character_class(lambda k: k[0] in 'LM')}]*")
#: Without one of these a word is what Python takes for letters, which is found faster.
ODD = frozenset(code_points(lambda k: k[0] == "M" or k in ("No", "Nl")))
PLAIN = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return (PLAIN if text.isascii() or ODD.isdisjoint(text) else LETTERS).findall(text)


ORDERS = (5, 4, 3, 2, 1)
CACHE_ENTRIES = 120_000


def fit(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample_rows: int = 10_000, entries: int = 60_000) -> dict[str, Any]:
    """A model from rows of (key, text, lang); the counting runs on Spark, the bounded result is gathered.

    The model: langs, their log shares, and for each order (0: words) its entries as one text with a table of
    their log frequencies by language."""
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull())
    share = min(1.0, sample_rows / max(1, rows.count()))
    lot = F.pmod(F.xxhash64(F.lit("language"), F.col(key)), F.lit(1 << 30))
    rows = rows.where(lot < int(share * (1 << 30)))
    words = rows.select(F.col(lang).alias("l"), F.explode(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(1))).alias("w")).groupBy("l", "w").agg(F.count("*").alias("n"))
    words = checkpointed(words)
    marked = F.concat(F.lit("<"), "w", F.lit(">"))
    grams = words.select("l", "n", marked.alias("w")).select("l", "n", "w", F.explode(F.array(*map(F.lit, ORDERS))).alias("k")).where("length(w) >= k")
    grams = grams.select("l", "n", "k", F.explode(F.expr("transform(sequence(1, length(w) - k + 1), i -> substring(w, i, k))")).alias("g")).groupBy("l", "k", "g").agg(F.sum("n").alias("n"))
    counts = checkpointed(words.select("l", F.lit(0).alias("k"), F.col("w").alias("g"), "n").union(grams.select("l", "k", "g", "n")))
    totals = {(r["l"], r["k"]): r["n"] for r in counts.groupBy("l", "k").agg(F.sum("n").alias("n")).collect()}
    shares = {r["l"]: r["n"] for r in rows.groupBy(F.col(lang).alias("l")).agg(F.count("*").alias("n")).collect()}
    langs = sorted({l for l, _ in totals})
    model: dict[str, Any] = {"id": uuid.uuid4().hex, "langs": langs, "prior": np.log([shares.get(l, 1) / sum(shares.values()) for l in langs]), "entries": []}
    if not langs:
        return model
    # an order's entries are dealt to the languages in equal parts: each takes the counts that its part has room for
    part, least = entries // len(langs), {}
    hist = counts.groupBy("k", "l", "n").agg(F.count("*").alias("m")).orderBy("k", "l", F.desc("n")).toArrow().to_pylist()  # a row per distinct count
    for (k, l), rows_ in groupby(hist, lambda r: (r["k"], r["l"])):
        room = part
        for r in rows_:
            room -= r["m"]
            if room < 0:
                break
            least[k, l] = r["n"]
    each = [F.coalesce(F.sum(F.when(F.col("l") == l, F.col("n"))), F.lit(0)).alias(f"n{i}") for i, l in enumerate(langs)]
    wanted = F.lit(False)
    for i, l in enumerate(langs):
        for k in (0, *ORDERS):
            wanted |= (F.col("k") == k) & (F.col(f"n{i}") >= least.get((k, l), 1 << 62))
    # a word met once tells of one text only
    kept = checkpointed(counts.groupBy("k", "g").agg(F.sum("n").alias("all"), *each).where(wanted & ((F.col("all") > 1) | (F.col("k") > 0))).drop("all"))
    for k in range(max(ORDERS) + 1):
        t = kept.where(F.col("k") == k).drop("k").toArrow().sort_by("g")
        n = np.stack([t[f"n{i}"].to_numpy() for i in range(len(langs))], axis=1)
        below = np.array([totals.get((l, k), 0) + 1000.0 for l in langs])
        model["entries"].append(("\n".join(t["g"].to_pylist()), np.log((n + 0.1) / below).astype("f4")))
    return model


class Scorer:
    """The model, and a bounded table of the scores of unseen words met of late: of two halves, the older one gives way."""

    def __init__(self, m: dict[str, Any]):
        self.langs, self.prior = m["langs"], m["prior"]
        self.index: list[dict[str, int]] = []
        tables, at = [np.zeros((0, len(self.langs)), "f4")], 0
        for names, table in m["entries"]:
            self.index.append({g: at + i for i, g in enumerate(names.split("\n"))} if len(table) else {})
            tables.append(table)
            at += len(table)
        self.known, self.half, self.used = at, 0, 0
        self.table = np.concatenate([*tables, np.zeros((2 * CACHE_ENTRIES, len(self.langs)), "f4")])
        self.words = dict(self.index[0]) if self.index else {}  # known ones and those of the newer half
        self.older: dict[str, int] = {}

    def unseen(self, word: str) -> int:
        if self.used == CACHE_ENTRIES:
            known = self.index[0]
            self.older = {w: i for w, i in self.words.items() if w not in known}
            self.words, self.half, self.used = dict(known), 1 - self.half, 0
        at = self.known + self.half * CACHE_ENTRIES + self.used
        before = self.older.get(word)
        self.table[at] = self.score_of(word) if before is None else self.table[before]
        self.words[word] = at
        self.used += 1
        return at

    def score_of(self, word: str) -> np.ndarray | float:
        marked = f"<{word}>"
        for k in ORDERS:
            index = self.index[k]
            seen = [i for j in range(len(marked) - k + 1) if (i := index.get(marked[j : j + k])) is not None]
            if seen:
                return self.table[seen].mean(0, dtype="f8")
        return 0.0

    def score(self, text: str | None) -> tuple[str, float]:
        words = words_of(text.lower()) if text and self.langs else []
        if not words:
            return "und", 0.0
        total = self.prior.copy()
        for lo in range(0, len(words), 4096):
            some = words[lo : lo + 4096]
            at = list(map(self.words.get, some))
            fresh = [w for w, i in zip(some, at, strict=True) if i is None] if None in at else []
            total += self.table[[i for i in at if i is not None]].sum(0, dtype="f8")
            for w in fresh:
                i = self.words.get(w)
                total += self.table[self.unseen(w) if i is None else i]
        p = np.exp(total - total.max())
        best = int(p.argmax())
        return self.langs[best], float(p[best] / p.sum())


def predicted(text: Column, model: dict[str, Any], spark: Any) -> Column:
    """struct<lang, score>; the model is bounded by fit's parameters."""
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        s = held(("language", m["id"]), lambda: Scorer(m))
        for b in batches:
            found = [s.score(t) for t in b.to_pylist()]
            yield pa.StructArray.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())], ["lang", "score"])

    return F.arrow_udf(run, "struct<lang: string, score: double>")(text)
