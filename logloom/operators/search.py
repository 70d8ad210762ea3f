"""Full-text search: an inverted index as a table, ranked by BM25.

The index holds a row for each word of each text, with what the word adds to the text's score. It is written in
the order of words, and of each word the weightiest first, so that the files' own statistics skip words that
aren't asked for and, once the k-th best score is known, all rows too light to be among the k best."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def postings(prompts: DataFrame, key: str = "prompt_id", text: str = "text") -> DataFrame:
    """(key, token, pos, len): where each lower-case run of letters and digits stands, and how many its text has. Nothing is moved."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return prompts.select(key, words.alias("w")).select(key, F.size("w").alias("len"), F.posexplode("w").alias("pos", "token")).select(key, "token", "pos", "len")


def words_of(prompts: DataFrame, key: str = "prompt_id", text: str = "text") -> DataFrame:
    """(key, token, len, positions): postings with a row for each word of a text. Nothing is moved: a text's words are sorted within its row, and runs of one word cut out."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    # each array is bound by a lambda, so that it is made once a text
    once = lambda value, f: F.transform(F.array(value), f)[0]
    new = lambda s: F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (x["token"] != F.get(s, i - 1)["token"]), i)), lambda i: i.isNotNull())
    run = lambda s, at: F.transform(at, lambda a, i: F.struct(s[a]["token"].alias("token"), F.slice(s, a + 1, F.coalesce(F.get(at, i + 1), F.size(s)) - a)["pos"].alias("positions")))
    in_order = lambda w: F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("token"), i.alias("pos"))))
    runs = once(in_order(F.col("w")), lambda s: once(new(s), lambda at: run(s, at)))
    return prompts.select(key, words.alias("w")).where(F.size("w") > 0).select(key, F.size("w").alias("len"), F.explode(runs).alias("r")).select(key, "r.token", "len", "r.positions")


def indexed(prompts: DataFrame, key: str = "prompt_id", text: str = "text") -> DataFrame:
    """What terms takes: words_of, or postings where a key has several rows, whose words count together."""
    repeated = prompts.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
    return words_of(prompts, key, text) if repeated.isEmpty() else postings(prompts, key, text)


def lengths(index: DataFrame, key: str = "prompt_id") -> DataFrame:
    """(key, len) of each text with a word."""
    return index.where("positions[0] = 0" if "positions" in index.columns else "pos = 0").select(key, "len")


def terms(postings: DataFrame, key: str = "prompt_id", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(token, key, weight, tf, df, positions): each word of each text, and what it adds to the text's score. postings: of postings, or of words_of where keys are distinct."""
    size = lengths(postings, key).agg(F.count("*").alias("n"), F.avg("len").alias("mean"))
    if "positions" in postings.columns:
        each = postings.select("token", key, F.size("positions").cast("long").alias("tf"), "len", "positions")
    else:
        each = postings.groupBy("token", key).agg(F.count("*").alias("tf"), F.first("len").alias("len"), F.sort_array(F.collect_list("pos")).alias("positions"))
    df = each.groupBy("token").agg(F.count("*").alias("df"))
    rows = each.join(df, "token").crossJoin(F.broadcast(size))  # one row
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    return rows.select("token", key, weight.alias("weight"), "tf", "df", "positions")


def write_terms(index: DataFrame, path: str, block: int = 1 << 20) -> None:
    """In the order of words and falling weights, in row groups of about block bytes."""
    order = [F.col("token"), F.desc("weight")]
    index.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").option("parquet.block.size", block).parquet(path)


def search(index: DataFrame, every: list[str] = (), some: list[str] = (), without: list[str] = (), phrase: list[str] = (), prefix: str | None = None, key: str = "prompt_id") -> DataFrame:
    """(key, score) of the texts that have all of every and of the phrase in order, one of some and of the words of the prefix, none of without.

    index: terms(). Scores over every, some, the phrase and words of the prefix; greater is better. Where words must
    be there, only texts of the rarest of them are looked at."""
    need = list(dict.fromkeys([*every, *phrase]))
    asked = list(dict.fromkeys([*need, *some]))
    hit = F.col("token").isin(asked)
    if prefix:
        hit = hit | F.col("token").startswith(prefix)
    found = index.where(hit | F.col("token").isin(list(without))) if without else index.where(hit)
    if len(need) > 1:
        # a row for each word
        rare = index.where(F.col("token").isin(need)).groupBy("token").agg(F.first("df").alias("df")).orderBy("df", "token").first()
        found = found.join(index.where(F.col("token") == (rare["token"] if rare else "")).select(key), key, "left_semi")
    count = lambda words: F.count_if(F.col("token").isin(list(words)))
    wanted = [count(need) == len(need)] if need else []
    wanted += [count(some) > 0] if some else []
    wanted += [count(without) == 0] if without else []
    wanted += [F.count_if(F.col("token").startswith(prefix)) > 0] if prefix else []
    cols = [F.sum(F.when(hit, F.col("weight"))).alias("score")] + [c.alias(f"w{i}") for i, c in enumerate(wanted)]
    if len(phrase) > 1:
        cols += [F.first(F.when(F.col("token") == w, F.col("positions")), ignorenulls=True).alias(f"p{i}") for i, w in enumerate(phrase)]
    rows = found.groupBy(key).agg(*cols)
    for i in range(len(wanted)):
        rows = rows.where(f"w{i}")
    if len(phrase) > 1:
        starts = F.col("p0")
        for i in range(1, len(phrase)):
            starts = F.array_intersect(starts, F.transform(f"p{i}", lambda p: p - F.lit(i)))  # noqa: B023
        rows = rows.where(F.size(starts) > 0)
    return rows.select(key, "score")


def best(index: DataFrame, some: list[str], k: int, key: str = "prompt_id") -> DataFrame:
    """(key, score) of texts among which are the k that score highest over some words, and all that score like the last of them.

    Texts are scored in full that hold one of the words at a weight of the k-th best of it; the k-th best of these
    scores bounds the k-th best of all, and nothing below it is returned. A text of at least that score has one word at no less than its share of
    it, so only rows of that weight are read for candidates."""
    words = list(dict.fromkeys(some))
    rows = index.where(F.col("token").isin(words))

    def scored(least: dict[str, float]) -> DataFrame:
        heavy = F.lit(False)
        for w, x in least.items():
            heavy |= (F.col("token") == w) & (F.col("weight") >= x)
        return rows.join(rows.where(heavy).select(key).distinct(), key, "left_semi").groupBy(key).agg(F.sum("weight").alias("score"))

    tops = {}
    for w in words:
        row = rows.where(F.col("token") == w).select("weight").orderBy(F.desc("weight")).limit(k).agg(F.min("weight"), F.max("weight")).first()
        if row[0] is not None:
            tops[w] = (row[0], row[1])
    if not tops:
        return rows.select(key, F.col("weight").alias("score")).limit(0)
    first = scored({w: low for w, (low, _) in tops.items()}).orderBy(F.desc("score")).limit(k).agg(F.min("score"), F.count("*")).first()
    bound = first[0] - 1e-9 if first[1] == k else 0.0
    rest = {w: max(bound / len(tops), bound - sum(high for v, (_, high) in tops.items() if v != w)) for w in tops}
    return scored(rest).where(F.col("score") >= bound)


def snippets(texts: DataFrame, words: list[str], text: str = "text", width: int = 18, before: int = 4, prefix: str | None = None) -> Column:
    """The words from a little before the first hit, hits in brackets, cut ends marked; null where there is no hit."""
    found = F.filter(F.split(F.lower(texts[text]), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    is_hit = lambda w: w.isin(words) | w.startswith(prefix) if prefix else w.isin(words)
    first = F.array_min(F.filter(F.transform(found, lambda w, i: F.when(is_hit(w), i)), lambda i: i.isNotNull()))
    at = F.greatest(first - before, F.lit(0))
    shown = F.transform(F.slice(found, at + 1, F.lit(width)), lambda w: F.when(is_hit(w), F.concat(F.lit("["), w, F.lit("]"))).otherwise(w))
    return F.concat(F.when(at > 0, "…").otherwise(""), F.array_join(shown, " "), F.when(at + width < F.size(found), "…").otherwise(""))
