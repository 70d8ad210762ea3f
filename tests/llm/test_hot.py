"""Repeats around anchors that very many documents have."""

import random

import pytest

from logloom.llm import repeats

from .test_operators import cut


@pytest.mark.parametrize("hot", [0, 5, 40])
def test_repeats_around_a_common_phrase(spark, hot):
    """Short of a string's length, one phrase in every third document, with the text around it new or repeated."""
    r = random.Random(hot)
    letters = "abcdefghijklmnopqrstuvwxyz "
    some = lambda n: "".join(r.choice(letters) for _ in range(n))
    phrase, tails = some(40), [some(60) for _ in range(6)]
    rows = []
    for k in range(300):
        t = some(120)
        if k % 3 == 0:
            t += phrase + (r.choice(tails) if k % 2 else some(60))
        rows.append((r.randrange(10**6), t + some(30)))
    rows += [(k + 10**7, t) for k, t in rows[:20]] + [(rows[0][0], rows[3][1])]
    found = repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), chunk_bytes=3000, bucket_entries=64, hot=hot)
    got = sorted((x["record"]["doc_id"], bytes(x["kept"])) for x in found.collect())
    assert got == sorted((k, b) for k, b, _ in cut(rows, 50)) and sum(len(b) for _, b in got) < sum(len(t) for _, t in rows)
