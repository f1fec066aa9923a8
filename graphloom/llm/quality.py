"""Quality by an interpolated modified Kneser-Ney model of character 5-grams.

The model is trained on all trusted text (documents labelled of good quality). Counts of the
highest order are summed over the corpus, sharded by n-gram; lower orders are continuation
counts, each an aggregation of the table above it; probabilities and backoff weights come from
joins of these tables by n-gram, suffix and context. A document's perplexity is over its
whole text, with its capitals, as shouting is a sign of poor text. One trusted document in HELD,
by a hash of its id, is kept from training. A document is kept if its perplexity lies between two
quantiles of its language: 1 - QUANTILE of all trusted ones, as the model knows most of them well, and
QUANTILE of the held-out ones, which are as new to the model as any other (or of all, if that is
more, as it may be where few are held out). Below are texts that repeat
themselves, above those that are no prose. Characters, not words: their tables follow the alphabet, so that pre-aggregated counts are
small against the text, and words that are new but regular are no surprise.

While the tables have at most MAX_ROWS rows (128 MB) they are broadcast; beyond that, documents'
n-gram counts are joined with the sharded tables. Both compute in double precision and give the same
perplexities.

Defined results: a null or empty text has the perplexity of the size of the alphabet; a
language without held-out trusted text (or null) takes the quantiles of all of it; without any
held-out trusted text everything is kept; repeated rows are scored one by one; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, mix64, text_batches
from .fingerprints import only

ORDER = 5
QUANTILE, HELD = 0.995, 5
MAX_ROWS = 4_000_000
START = "\x00"
CHUNK = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def trusted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, lang of the documents labelled quality = 1. A Bloom filter of their ids
    (16 MB at most) lets the scan drop the others before the exact join."""
    ids = materialize(labels.filter("quality = 1 and doc_id is not null").select("doc_id").distinct())
    return only(docs.select("doc_id", "text", "lang"), "doc_id", ids).join(ids, "doc_id", "left_semi")


def _grams(text: str | None, order: int) -> list[str]:
    text = text or ""
    padded = START * (order - 1) + text
    return [padded[i : i + order] for i in range(len(text))]


def _hash(points: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams that end at each position from n - 1 on."""
    return _fold([points[j : len(points) - n + 1 + j] for j in range(n)])


def _fold(columns) -> np.ndarray:
    """A hash of the code points in each row; columns holds the first ones, the second ones, and so on."""
    h = np.full(len(columns[0]), len(columns), dtype=np.uint64)
    for c in columns:
        h = (h ^ c) * _ODD
        h ^= h >> np.uint64(29)
    return mix64(h)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)


def counts(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """g, c: the n-grams of the highest order; c is summed before it is shuffled."""

    text_batches(texts.sparkSession)
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()
        for pdf in batches:
            for text in pdf["text"]:
                held.update(_grams(text, order))
                if len(held) > 300_000:
                    yield pd.DataFrame({"g": list(held), "c": list(held.values())})
                    held = Counter()
        if held:
            yield pd.DataFrame({"g": list(held), "c": list(held.values())})

    return texts.select(F.col("text").cast("string").alias("text")).mapInPandas(run, "g string, c long").groupBy("g").agg(F.sum("c").alias("c"))


def _discounts(n: dict[int, int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of n-grams with counts 1 to 4."""
    n1, n2, n3, n4 = (n.get(i, 0) for i in (1, 2, 3, 4))
    if not (n1 and n2 and n3 and n4):
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(d, 0.05), i) for i, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3)))


def train(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """kind, g, value: log-probabilities (kind 'p', of n-grams of all orders) and log backoff
    weights (kind 'b', of contexts; the empty one also holds the uniform share). A written table."""
    tables = {order: materialize(counts(texts, order))}
    for n in range(order - 1, 0, -1):  # continuation counts; a start is never predicted
        tables[n] = materialize(tables[n + 1].groupBy(F.substring("g", 2, n).alias("g")).agg(F.count("*").alias("c")))
    letters = tables[1].count() + 1
    out: DataFrame | None = None
    lower: DataFrame | None = None
    for n in range(1, order + 1):
        few = {r[0]: r[1] for r in tables[n].filter("c <= 4").groupBy("c").count().collect()}
        d = _discounts(few)
        cut = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        rows = tables[n].withColumn("ctx", F.substring("g", 1, n - 1)).withColumn("suffix", F.substring("g", 2, n - 1))
        ctx = rows.groupBy("ctx").agg(F.sum("c").alias("all"), (F.sum(cut) / F.sum("c")).alias("back"))
        rows = rows.join(ctx, "ctx")
        below = F.lit(1.0 / letters)
        if lower is not None:
            rows = rows.join(lower.select(F.col("g").alias("suffix"), F.col("p").alias("below")), "suffix")
            below = F.col("below")
        p = F.greatest(F.col("c") - cut, F.lit(0.0)) / F.col("all") + F.col("back") * below
        lower = materialize(rows.select("g", p.alias("p")))
        part = lower.select(F.lit("p").alias("kind"), "g", F.log("p").alias("value")).union(ctx.select(F.lit("b"), "ctx", F.log("back")))
        out = part if out is None else out.union(part)
    uniform = out.sparkSession.range(1).select(F.lit("u"), F.lit(""), F.lit(-math.log(letters)))
    return materialize(out.union(uniform))


class Table:
    """Hash to value by open addressing, looked up for arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, math.ceil(math.log2(max(1, len(keys)) * 2)))
        self.mask = np.uint64((1 << bits) - 1)
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.float64)
        left, at = np.arange(len(keys)), (keys & self.mask).astype(np.int64)
        while len(left):
            slot = at[left]
            free = self.keys[slot] == 0
            first = np.zeros(len(left), dtype=bool)
            first[np.unique(slot, return_index=True)[1]] = True
            put = left[free & first]
            self.keys[at[put]], self.values[at[put]] = keys[put], values[put]
            left = left[~(free & first)]
            at[left] = (at[left] + (self.keys[at[left]] != 0)) & int(self.mask)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(found, value)."""
        at = (keys & self.mask).astype(np.int64)
        held = self.keys[at]
        found, values = held == keys, self.values[at]
        left = np.flatnonzero(~found & (held != 0))
        while len(left):
            at[left] = (at[left] + 1) & int(self.mask)
            held = self.keys[at[left]]
            hit = held == keys[left]
            found[left[hit]] = True
            values[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (held != 0)]
        return found, values


def packed(table: DataFrame) -> pd.DataFrame:
    """kind, n, hash, value of the rows of train(): 21 bytes each, hashed where they are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sizes = pdf["g"].str.len()
            for n, own in pdf.groupby(sizes):
                h = np.zeros(len(own), dtype=np.uint64)
                if n:
                    h = _fold(_points("".join(own["g"])).reshape(-1, int(n)).T)
                yield pd.DataFrame({"kind": own["kind"], "n": np.int8(n), "hash": h.view(np.int64), "value": own["value"]})

    rows = table.repartition("kind", F.pmod(F.xxhash64("g"), F.lit(16)))
    return rows.mapInPandas(run, "kind string, n tinyint, hash long, value double").toArrow().to_pandas()


class Model:
    """The tables of all orders, from packed()."""

    def __init__(self, rows: pd.DataFrame):
        self.order = int(rows.loc[rows["kind"] == "p", "n"].max()) if (rows["kind"] == "p").any() else 0
        self.uniform = float(rows.loc[rows["kind"] == "u", "value"].sum())
        self.p, self.b = {}, {0: 0.0}
        for kind, held in (("p", self.p), ("b", self.b)):
            for n, own in rows[rows["kind"] == kind].groupby("n"):
                values = own["value"].to_numpy(dtype=np.float64)
                held[int(n)] = Table(own["hash"].to_numpy().view(np.uint64), values) if n else float(values[0])

    def log_p(self, points: np.ndarray) -> np.ndarray:
        """Of each position from order - 1 on, given what stands before it."""
        out = np.zeros(len(points) - self.order + 1, dtype=np.float64)
        left = np.arange(len(out))
        for n in range(self.order, 0, -1):
            grams = _hash(points, n)[self.order - n :]
            found, value = self.p[n].get(grams[left])
            out[left[found]] += value[found]
            left = left[~found]
            if not len(left):
                return out
            if n > 1:
                ctx = _hash(points, n - 1)[self.order - n : self.order - n + len(out)]
                out[left] += np.where((got := self.b[n - 1].get(ctx[left]))[0], got[1], 0.0)
        out[left] += self.b[0] + self.uniform
        return out


def _perplexity(model: Model, texts: list[str]) -> np.ndarray:
    whole = [t or "" for t in texts]
    start = START * (model.order - 1)
    points = _points("".join(start + t for t in whole) or start)
    sizes = np.array([len(t) for t in whole])
    ends = np.cumsum(sizes + model.order - 1)
    log_p = model.log_p(points) if len(points) >= model.order else np.zeros(0)
    sums = np.concatenate([[0.0], np.cumsum(log_p)])
    first = ends - sizes - (model.order - 1)  # positions of a text begin where its padding ends
    total = sums[np.minimum(first + sizes, len(log_p))] - sums[np.minimum(first, len(log_p))]
    return np.exp(np.where(sizes > 0, -total / np.maximum(sizes, 1), -model.uniform))


def score(docs: DataFrame, table: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, lang, perplexity (null without a model). table: of train()."""
    text_batches(docs.sparkSession)
    rows = docs.select("doc_id", "lang", F.col("text").cast("string").alias("text"))
    n = table.count()
    if n <= max_rows:
        held = docs.sparkSession.sparkContext.broadcast(Model(packed(table)))

        def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = held.value
            for s in texts:
                out, start, size = [], 0, 0
                for k, t in enumerate(s):
                    size += len(t or "")
                    if size >= CHUNK or k == len(s) - 1:
                        out.append(_perplexity(model, list(s.iloc[start : k + 1])))
                        start, size = k + 1, 0
                yield pd.Series(np.concatenate(out) if out else np.zeros(0))

        if held.value.order == 0:
            return rows.select("doc_id", "lang", F.lit(None).cast("double").alias("perplexity"))
        return rows.select("doc_id", "lang", F.pandas_udf(run, "double")("text").alias("perplexity"))
    return _score_sharded(rows, table)


def _score_sharded(rows: DataFrame, table: DataFrame) -> DataFrame:
    """The same by joins: distinct n-grams are resolved order by order, texts by their digest."""
    order = table.filter("kind = 'p'").agg(F.max(F.length("g"))).first()[0]
    uniform = table.filter("kind = 'u'").first()["value"]

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for key, text in zip(pdf["key"], pdf["text"], strict=True):
                if own := Counter(_grams(text, order)):
                    yield pd.DataFrame({"key": [key] * len(own), "g": list(own), "n": list(own.values())})

    key = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    keyed = rows.withColumn("key", key)
    own = materialize(keyed.select("key", "text").dropDuplicates(["key"]).mapInPandas(grams, "key string, g string, n long"))
    p = table.filter("kind = 'p'").select(F.col("g").alias("at"), F.col("value").alias("p"))
    b = table.filter("kind = 'b'").select(F.col("g").alias("ctx"), F.col("value").alias("b"))
    each = own.select("g").distinct().withColumn("value", F.lit(0.0)).withColumn("at", F.col("g"))
    done: DataFrame | None = None
    for n in range(order, 0, -1):
        got = materialize(each.join(p, "at", "left"))
        found = got.filter("p is not null").select("g", (F.col("value") + F.col("p")).alias("value"))
        done = found if done is None else done.union(found)
        each = got.filter("p is null").withColumn("ctx", F.substring("at", 1, n - 1)).join(b, "ctx", "left")
        each = each.select("g", (F.col("value") + F.coalesce("b", F.lit(0.0))).alias("value"), F.substring("at", 2, n - 1).alias("at"))
    done = done.union(each.select("g", (F.col("value") + uniform).alias("value")))
    sums = own.join(done, "g").groupBy("key").agg((F.sum(F.col("n") * F.col("value")) / F.sum("n")).alias("mean"))
    return keyed.join(sums, "key", "left").select("doc_id", "lang", F.exp(-F.coalesce("mean", F.lit(uniform))).alias("perplexity"))


def held_out(held: int = HELD) -> Column:
    return F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("held")), F.lit(held)) == 0


def classify(docs: DataFrame, trusted: DataFrame, quantile: float = QUANTILE, held: int = HELD) -> DataFrame:
    """doc_id, lang, perplexity, least, threshold, kept."""
    scored = materialize(score(docs, train(trusted.filter(~held_out(held)))))
    known = scored.join(trusted.select("doc_id").distinct(), "doc_id", "left_semi")
    low, most = (F.percentile_approx("perplexity", x, 10000) for x in (1 - quantile, quantile))
    high = F.percentile_approx(F.when(held_out(held), F.col("perplexity")), quantile, 10000)
    q = F.when(high.isNotNull(), F.array(low, F.greatest(high, most)))
    by_lang = known.filter("lang is not null").groupBy(F.col("lang").alias("__lang")).agg(q.alias("__own"))
    every = known.agg(q.alias("q")).scalar()
    out = scored.join(by_lang, F.col("lang") == F.col("__lang"), "left").withColumn("__q", F.coalesce("__own", every))
    kept = F.coalesce(F.col("perplexity").between(F.get("__q", F.lit(0)), F.get("__q", F.lit(1))), F.lit(True))
    return out.select("doc_id", "lang", "perplexity", F.get("__q", F.lit(0)).alias("least"), F.get("__q", F.lit(1)).alias("threshold"), kept.alias("kept"))
