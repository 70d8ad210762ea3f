"""Removal of byte strings that an earlier document already has.

Suffixes are compared by their first ``length`` bytes. Only sampled suffixes are sorted outright: the
anchors, local minima of a hash of ``gram`` bytes, one at least in every string of ``length`` bytes and at
the same place in equal strings. What holds for the anchors is induced for the suffixes between them:

1. each chunk of documents sends the anchors' hashes, once each, to be sorted in buckets; the hashes that
   more than one document has come back;
2. around those anchors the chunks send the strings that hold them (once each, with the smallest
   document) to be sorted in full; each string of ``length`` bytes gets its smallest document;
3. a chunk marks the bytes of its documents whose strings have a smaller document.

All three passes read one shuffle of the texts (chunks are dealt by a hash of id and text, and bounded by
``chunk_bytes``); nothing but hashes of anchors and the strings around repeated ones is moved besides. A
passage that very many documents share counts once a chunk where the text around it is the same too. Around
an anchor of more than ``hot`` documents the chunks send, instead, the hash of each string of ``length``
bytes with its smallest document, to buckets by that hash, so that one anchor spreads over all of them.
Strings are told apart by 128-bit hashes, the units of one chunk by 96 bits. Ids are integers.

Defined cases: a null text has no bytes; rows without an id neither remove nor lose anything; rows that
repeat an id do not remove each other; texts shorter than ``length`` stay as they are; the input's columns
stay inside ``record``, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released

MIX = np.uint64(0xD6E8FEB86659FD93)
BLOCK = 1 << 17  # strings hashed at once
FOLDS = 16
SENT = ("ids", "docs", "counts", "folds", "bytes")
REPLY = "__chunk int, ids binary, counts binary, runs binary, docs binary"
PAIR = np.dtype([("a", "u8"), ("b", "u4")])


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * MIX
    return x ^ (x >> np.uint64(29))


def rolled(b: np.ndarray, length: int, seed: int) -> np.ndarray:
    """64-bit hashes of all strings of length bytes, by doubling."""
    odd = np.uint64(2 * seed + 0x9E3779B97F4A7C15)
    of_byte = mixed((np.arange(256, dtype="u8") + np.uint64(seed + 1)) * MIX)
    now, size, out, done, rest = of_byte[b], 1, None, 0, length
    while True:
        if rest & 1:
            n = len(b) - done - size + 1
            out = now[:n] if out is None else joined(out[:n], now[done : done + n], odd)
            done += size
        rest >>= 1
        if not rest:
            return mixed(out)
        now = joined(now[:-size], now[size:], odd)
        size *= 2


def joined(a: np.ndarray, b: np.ndarray, odd: np.uint64) -> np.ndarray:
    x = a * odd
    x += b
    x ^= x >> np.uint64(32)
    return x


def segment_ids(part: np.ndarray, first: np.ndarray, last: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes, of 64 and 32 bits, of the bytes from string first to string last (less than length apart), of all of them at once."""
    size = (last - first).astype("u8")
    out = []
    for seed in (2, 5):
        h = rolled(part, length, seed)
        out.append(mixed(mixed(h[first] * MIX + h[last]) + size))
    return out[0], (out[1] >> np.uint64(32)).astype("u4")


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    both = np.empty(len(a), PAIR)
    both["a"], both["b"] = a, b
    return both


def found_in(one: np.ndarray, two: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each (a, b) among the sorted pairs (one, two), and whether it is there."""
    place = np.searchsorted(one, a)
    end = len(one) - 1
    while True:  # on over pairs of one first hash; as good as never more than one
        at = np.minimum(place, end)
        on = (place <= end) & (one[at] == a) & (two[at] < b)
        if not on.any():
            return at, (one[at] == a) & (two[at] == b)
        place = place + on


class Chunk:
    """A chunk's documents end to end, and the units of their strings: runs of strings with one anchor.

    Worked off block by block; a run that a block's end cuts is two runs of the same anchor."""

    def __init__(self, table: pa.Table, key: str, text: str, length: int, gram: int):
        self.keys, self.length, self.gram = table[key].to_pylist(), length, gram
        self.bytes = [np.frombuffer((t or "").encode(), "u1") for t in table[text].to_pylist()]
        used = [i for i, (k, b) in enumerate(zip(self.keys, self.bytes, strict=True)) if k is not None and len(b) >= length]
        self.rows = np.array(used, "i8")
        self.key = np.array([self.keys[i] for i in used], "i8")
        sizes = np.array([len(self.bytes[i]) for i in used], "i8")
        self.every = np.concatenate([np.zeros(0, "u1"), *(self.bytes[i] for i in used)])
        self.begin = np.cumsum(sizes) - sizes
        self.sizes = sizes

    def units(self) -> Iterator[tuple[np.ndarray, ...]]:
        """document (place among those used), first string (place in every), strings, anchor's hash, first and last string in part, part."""
        length, reach = self.length, self.length - self.gram + 1  # reach: anchors that a string may have
        for lo in range(0, len(self.every) - length + 1, BLOCK):
            part = self.every[lo : lo + BLOCK + length - 1]
            h = rolled(part, self.gram, 1)
            low, at, size = (h >> np.uint64(32)).astype("u4"), np.arange(len(h), dtype="i4"), 1
            while size < reach:  # leftmost minimum of reach hashes
                step = min(size, reach - size)
                left, right = low[:-step], low[step:]
                at = np.where(left <= right, at[:-step], at[step:])
                low = np.minimum(left, right)
                size += step
            d0, d1 = np.searchsorted(self.begin, (lo, lo + len(at) - 1), "right") - 1
            docs = np.arange(d0, d1 + 1)
            ends = np.minimum(self.begin[docs] + self.sizes[docs] - lo, len(at) + length - 1)
            starts = np.maximum(self.begin[docs] - lo, 0)
            stop = ends - length + 1  # strings of each document in this block: starts to stop
            edge = at[1:] != at[:-1]
            cut = np.zeros(len(at) + 1, bool)
            cut[1:-1] = edge
            cut[starts] = True
            cut[np.maximum(stop, 0)] = True
            first = np.flatnonzero(cut[:-1])
            last = np.r_[first[1:], len(at)] - 1
            doc = np.searchsorted(self.begin, first + lo, "right") - 1
            inside = first < stop[doc - d0]
            first, last, doc = first[inside], last[inside], doc[inside]
            yield doc, first + lo, last - first + 1, h[at[first]], first, last, part


def gathered(table: pa.Table, name: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(table[name].to_pylist()), kind)


def spread(at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """at[i], at[i] + 1, ... n[i] of them, for all i."""
    return np.repeat(at - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 50, gram: int = 20, chunk_bytes: int = 4 << 20, bucket_entries: int = 1 << 20, hot: int = 1 << 16, characters: bool = False) -> DataFrame:
    """record (struct of docs' columns), kept (binary, the remaining bytes) and spans (array of start and length of the maximal removed runs).

    characters: a character of which a byte is removed goes whole, so that what is kept is text."""
    names, total = docs.columns, docs.select(F.sum(F.octet_length(text))).first()[0] or 0
    docs = docs.toDF(*[f"c{i}" for i in range(len(names))])
    key, text = f"c{names.index(key)}", f"c{names.index(text)}"
    chunks = max(1, -(-total // chunk_bytes))
    buckets = max(1, -(-total // (bucket_entries * 16)))
    small = "u1" if length < 256 else "u4"  # holds how many strings may share an anchor
    rows = docs.withColumn("__chunk", F.pmod(F.xxhash64(key, text), F.lit(chunks)).cast("int"))
    schema = rows.schema

    def anchors(table: pa.Table) -> pa.Table:
        """The chunk's anchor hashes by bucket, and whether two of its documents have them."""
        released()
        chunk = Chunk(table, key, text, length, gram)
        seen = [(h, chunk.key[doc]) for doc, _, _, h, *_ in chunk.units()]
        h, o = (np.concatenate([np.zeros(0, t), *(x[k] for x in seen)]) for k, t in ((0, "u8"), (1, "i8")))
        order = np.lexsort((o, h))
        h, o = h[order], o[order]
        new = np.r_[True, h[1:] != h[:-1]][: len(h)]
        first = np.flatnonzero(new)
        once = np.r_[True, (h[1:] != h[:-1]) | (o[1:] != o[:-1])][: len(h)]
        number = np.add.reduceat(once.astype("i8"), first) if len(h) else np.zeros(0, "i8")
        h = h[first]
        bucket = (h % np.uint64(buckets)).astype("i8")
        order = np.lexsort((h, bucket))
        h, number, bucket = (h // np.uint64(buckets))[order].astype("u4"), number[order], bucket[order]
        many = number > 1
        some, at = np.unique(bucket, return_index=True)
        parts = list(zip(at, np.r_[at[1:], len(h)][: len(at)], strict=True))
        # a hash goes as 32 bits beside its bucket; another string with the same bits only adds work in the second pass
        return pa.table({"bucket": pa.array(some, pa.int32()), "__chunk": pa.array(np.full(len(some), table["__chunk"][0].as_py()), pa.int32()), "keys": pa.array([h[a:b].tobytes() for a, b in parts], pa.binary()), "many": pa.array([np.packbits(many[a:b]).tobytes() for a, b in parts], pa.binary()), "docs": pa.array([np.minimum(number[a:b][many[a:b]], 65535).astype("u2").tobytes() for a, b in parts], pa.binary())})

    def repeated(table: pa.Table) -> pa.Table:
        """Of each chunk's hashes in a bucket, those that more than one document has, and whether more than hot documents have them."""
        released()
        keys = [np.frombuffer(x, "u4") for x in table["keys"].to_pylist()]
        many = np.concatenate([np.unpackbits(np.frombuffer(x, "u1"))[: len(k)] for x, k in zip(table["many"].to_pylist(), keys, strict=True)]).astype(bool)
        every = np.sort(np.concatenate([*keys, np.concatenate(keys)[many]]))
        twice = np.unique(every[1:][every[1:] == every[:-1]])
        found = [k[np.isin(k, twice, assume_unique=True)] for k in keys]
        number = np.ones(len(many), "i8")
        number[many] = gathered(table, "docs", "u2")
        place = np.minimum(np.searchsorted(twice, np.concatenate(keys)), max(len(twice) - 1, 0))
        hit = twice[place] == np.concatenate(keys) if len(twice) else np.zeros(len(many), bool)
        crowd = np.bincount(place[hit], number[hit], len(twice)) > hot
        crowds = [np.packbits(crowd[np.searchsorted(twice, k)]).tobytes() for k in found]
        return pa.table({"bucket": table["bucket"], "__chunk": table["__chunk"], "keys": pa.array([k.tobytes() for k in found], pa.binary()), "hot": pa.array(crowds, pa.binary())})

    def strings(table: pa.Table, shared: pa.Table) -> pa.Table:
        """The strings around the chunk's repeated anchors, once each with their smallest document."""
        released()
        known = [np.frombuffer(k, "u4").astype("u8") << np.uint64(32) | np.uint64(b) for b, k in zip(shared["bucket"].to_pylist(), shared["keys"].to_pylist(), strict=True)]
        crowd = np.concatenate([np.zeros(0, "u1"), *(np.unpackbits(np.frombuffer(x, "u1"))[: len(k)] for x, k in zip(shared["hot"].to_pylist(), known, strict=True))]).astype(bool)
        known = np.concatenate([np.zeros(0, "u8"), *known])
        order = np.argsort(known)
        known, crowd = known[order], crowd[order]
        lone: list[tuple[np.ndarray, ...]] = []
        cols: list[list[np.ndarray]] = [[] for _ in range(7)]
        bytes_: list[np.ndarray] = []
        if len(known) and table.num_rows:
            chunk = Chunk(table, key, text, length, gram)
            for doc, _, n, h, first, last, part in chunk.units():
                rest, bucket = h // np.uint64(buckets), h % np.uint64(buckets)
                code = rest.astype("u4").astype("u8") << np.uint64(32) | bucket
                place = np.minimum(np.searchsorted(known, code), len(known) - 1)
                hit = known[place] == code
                many = np.flatnonzero(hit & crowd[place])
                hit = np.flatnonzero(hit & ~crowd[place])
                if len(many):
                    at = spread(first[many], n[many])
                    lone.append((rolled(part, length, 3)[at], rolled(part, length, 4)[at], np.repeat(chunk.key[doc[many]], n[many])))
                if len(hit):
                    one, two = segment_ids(part, first[hit], last[hit], length)
                    fold = (rest[hit] >> np.uint64(32)).astype("u1") % FOLDS
                    for c, x in zip(cols, (one, two, chunk.key[doc[hit]], bucket[hit].astype("i8"), n[hit], n[hit] + length - 1, fold), strict=True):
                        c.append(x)
                    bytes_.append(part[spread(first[hit], n[hit] + length - 1)])
        found, out = alone(lone), []
        if not bytes_:
            return sent_table(table, found, np.zeros(0, "i8"), out)
        one, two, doc, bucket, n, m, fold = map(np.concatenate, cols)
        ids, every, start = paired(one, two), np.concatenate(bytes_), np.cumsum(m) - m
        order = np.lexsort((doc, two, one, bucket))
        order = order[np.r_[True, ids[order][1:] != ids[order][:-1]]]
        some, at = np.unique(bucket[order], return_index=True)
        for a, b in zip(at, np.r_[at[1:], len(order)], strict=True):
            o = order[a:b]
            out.append((ids[o].tobytes(), doc[o].tobytes(), n[o].astype(small).tobytes(), fold[o].tobytes(), every[spread(start[o], m[o])].tobytes()))
        return sent_table(table, found, some, out)

    def alone(lone: list[tuple[np.ndarray, ...]]) -> list[tuple[int, tuple[bytes, ...]]]:
        """The chunk's strings around hot anchors by bucket: two hashes, the smallest document, and whether the chunk has another."""
        if not lone:
            return []
        one, two, doc = map(np.concatenate, zip(*lone, strict=True))
        order = np.lexsort((doc, two, one))
        one, two, doc = one[order], two[order], doc[order]
        head = np.flatnonzero(np.r_[True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])])
        more = doc[np.r_[head[1:], len(doc)] - 1] > doc[head]
        one, two, doc = one[head], two[head], doc[head]
        bucket = (two % np.uint64(4 * buckets)).astype("i8") + buckets  # beyond those of the anchors
        order = np.argsort(bucket, kind="stable")
        some, at = np.unique(bucket[order], return_index=True)
        parts = [order[a:b] for a, b in zip(at, np.r_[at[1:], len(order)], strict=True)]
        return [(int(b), (one[o].tobytes(), doc[o].tobytes(), b"", more[o].astype("u1").tobytes(), two[o].tobytes())) for b, o in zip(some, parts, strict=True)]

    def sent_table(table: pa.Table, found: list[tuple[int, tuple[bytes, ...]]], some: np.ndarray, out: list[tuple[bytes, ...]]) -> pa.Table:
        every = [*out, *(x for _, x in found)]
        number = table["__chunk"][0].as_py() if every else 0
        return pa.table({"bucket": pa.array([*some.tolist(), *(b for b, _ in found)], pa.int32()), "__chunk": pa.array([number] * len(every), pa.int32()), **{c: pa.array([x[k] for x in every], pa.binary()) for k, c in enumerate(SENT)}})

    def smallest_alone(table: pa.Table) -> pa.Table:
        """For each chunk's strings around hot anchors in a bucket: their smallest document, where the chunk has a greater one."""
        one, two, doc, more = (gathered(table, c, k) for c, k in (("ids", "u8"), ("bytes", "u8"), ("docs", "i8"), ("folds", "u1")))
        order = np.lexsort((two, one))
        new = np.r_[True, (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])]
        least = np.empty(len(order), "i8")
        least[order] = np.minimum.reduceat(doc[order], np.flatnonzero(new))[np.cumsum(new) - 1]
        needed, out, done = (least < doc) | (more > 0), [], 0
        for x in table["ids"].to_pylist():
            k = np.arange(done, done + len(x) // 8)
            done += len(k)
            k = k[needed[k]]
            out.append((one[k].tobytes(), b"", two[k].tobytes(), least[k].tobytes()))
        return pa.table({"__chunk": table["__chunk"], **{c: pa.array(x, pa.binary()) for c, x in zip(("ids", "counts", "runs", "docs"), zip(*out, strict=True), strict=True)}})

    def smallest(table: pa.Table) -> pa.Table:
        """For each chunk's strings in a bucket: runs of sub-strings with one smallest document, where it isn't the chunk's own alone."""
        released()
        if table["bucket"][0].as_py() >= buckets:
            return smallest_alone(table)
        ids = [np.frombuffer(x, PAIR) for x in table["ids"].to_pylist()]
        doc, n = gathered(table, "docs", "i8"), gathered(table, "counts", small).astype("i8")
        fold, every, size = gathered(table, "folds", "u1"), gathered(table, "bytes", "u1"), n + length - 1
        begin, place = np.cumsum(size) - size, np.cumsum(n) - n
        mine = np.empty(n.sum(), "i8")
        for f in range(FOLDS):  # strings of one anchor are in one fold; a fold at a time bounds the memory
            own = np.flatnonzero(fold == f)
            if not len(own):
                continue
            some = every[spread(begin[own], size[own])]
            at = spread(np.cumsum(size[own]) - size[own], n[own])
            one, two = rolled(some, length, 3)[at], rolled(some, length, 4)[at]
            order = np.lexsort((two, one))
            new = np.r_[True, (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])]
            least = np.minimum.reduceat(np.repeat(doc[own], n[own])[order], np.flatnonzero(new))
            found = np.empty(len(order), "i8")
            found[order] = least[np.cumsum(new) - 1]
            mine[spread(place[own], n[own])] = found
        unit = np.repeat(np.arange(len(n)), n)
        head = np.flatnonzero(np.r_[True, (mine[1:] != mine[:-1]) | (unit[1:] != unit[:-1])])
        runs, of = np.diff(np.r_[head, len(mine)]), unit[head]
        count = np.bincount(of, minlength=len(n))
        where = np.cumsum(count) - count
        out, done = [], 0
        for x in ids:
            k = np.arange(done, done + len(x))
            done += len(x)
            r = spread(where[k], count[k])
            out.append((x.tobytes(), count[k].astype(small).tobytes(), runs[r].astype(small).tobytes(), mine[head[r]].tobytes()))
        return pa.table({"__chunk": table["__chunk"], **{c: pa.array(x, pa.binary()) for c, x in zip(("ids", "counts", "runs", "docs"), zip(*out, strict=True), strict=True)}})

    def cut(table: pa.Table, reply: pa.Table) -> pa.Table:
        """The chunk's documents without the bytes of strings that a smaller document has."""
        released()
        if not table.num_rows:
            return pa.Table.from_arrays([*table.columns[:-1], pa.array([], pa.binary()), pa.array([], SPANS)], names=out_names)
        lone = pc.and_(pc.equal(pc.binary_length(reply["counts"]), 0), pc.greater(pc.binary_length(reply["ids"]), 0))
        reply, apart = reply.filter(pc.invert(lone)), reply.filter(lone)
        one, two, other = gathered(apart, "ids", "u8"), gathered(apart, "runs", "u8"), gathered(apart, "docs", "i8")
        order = np.lexsort((two, one))
        one, two, other = one[order], two[order], other[order]
        ids, count = gathered(reply, "ids", PAIR), gathered(reply, "counts", small).astype("i8")
        runs, least = gathered(reply, "runs", small).astype("i8"), gathered(reply, "docs", "i8")
        order = np.lexsort((ids["b"], ids["a"]))
        first_id, second_id, where, count = ids["a"][order], ids["b"][order], (np.cumsum(count) - count)[order], count[order]
        chunk = Chunk(table, key, text, length, gram)
        edge = np.zeros(len(chunk.every) + 1, "i4")
        for doc, start, n, _, first, last, part in chunk.units() if len(ids) or len(one) else ():
            if len(one):
                at = spread(first, n)
                place, hit = found_in(one, two, rolled(part, length, 3)[at], rolled(part, length, 4)[at])
                owner = np.repeat(chunk.key[doc], n)
                gone = hit & (other[place] < owner)
                begin = spread(start, n)[gone]
                np.add.at(edge, begin, 1)
                np.add.at(edge, begin + length, -1)
            if not len(ids):
                continue
            place, hit = found_in(first_id, second_id, *segment_ids(part, first, last, length))
            hit = np.flatnonzero(hit)
            if len(hit):
                c = count[place[hit]]
                r = spread(where[place[hit]], c)
                ends = np.cumsum(runs[r])
                before = np.cumsum(c) - c  # each unit's first run
                begin = np.repeat(start[hit], c) + ends - runs[r] - np.repeat(ends[before] - runs[r][before], c)
                gone = least[r] < np.repeat(chunk.key[doc[hit]], c)
                np.add.at(edge, begin[gone], 1)
                np.add.at(edge, (begin + runs[r] - 1 + length)[gone], -1)
        stays = np.cumsum(edge[:-1]) == 0
        part_of = {int(row): stays[a : a + n] for row, a, n in zip(chunk.rows, chunk.begin, chunk.sizes, strict=True)}
        kept, spans = [], []
        for row, b in enumerate(chunk.bytes):
            left = part_of.get(row)
            if left is None or left.all():
                kept.append(b.tobytes())
                spans.append([])
                continue
            if characters:
                number = np.maximum(np.cumsum((b & 0xC0) != 0x80) - 1, 0)
                broken = np.zeros(number[-1] + 1, bool)
                broken[number[~left]] = True
                left = ~broken[number]
            kept.append(b[left].tobytes())
            turn = np.flatnonzero(np.diff(np.r_[True, left, True]))
            spans.append([{"start": int(a), "length": int(z - a)} for a, z in zip(turn[::2], turn[1::2], strict=True)])
        return pa.Table.from_arrays([*table.columns[:-1], pa.array(kept, pa.binary()), pa.array(spans, SPANS)], names=out_names)

    out_names = [*docs.columns, "kept", "spans"]
    sent = rows.groupBy("__chunk").applyInArrow(anchors, "bucket int, __chunk int, keys binary, many binary, docs binary")
    back = sent.groupBy("bucket").applyInArrow(repeated, "bucket int, __chunk int, keys binary, hot binary")
    around = rows.groupBy("__chunk").cogroup(back.groupBy("__chunk")).applyInArrow(strings, "bucket int, __chunk int, ids binary, docs binary, counts binary, folds binary, bytes binary")
    reply = around.groupBy("bucket").applyInArrow(smallest, REPLY)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema if f.name != "__chunk")
    left = rows.groupBy("__chunk").cogroup(reply.groupBy("__chunk")).applyInArrow(cut, f"{fields}, kept binary, spans array<struct<start: long, length: long>>")
    return left.select(F.struct(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)]).alias("record"), "kept", "spans")


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
