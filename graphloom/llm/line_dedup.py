"""Line dedup that can be taken back: exact reference counts behind sharded cuckoo filters.

The exact table holds postings (key, doc_id) of all long lines; a key's reference count is the
number of documents that hold it. Documents are inserted as new postings and deleted by
their doc_id; then the keys that they hold are counted again, and only those. Keys whose
count reaches the limit stand in cuckoo filters, one for each shard of the key space: a key that reaches
it is inserted into its shard's filter, one that falls below is deleted from it. So an index after
any insertions and deletions gives the decisions of one made at once, and every decision can be reversed.
A scan of the postings asks the filters first and sends only what they let through to the exact
counts, which settle it.

Keys are the 128-bit xxh3 digests of the normalised lines. Filters are broadcast while they
are under MAX_FILTER_BYTES; beyond that, all postings go to the exact counts. Keys with more than
a fair share of all postings (2 * partitions of them at most) meet their counts by broadcast,
the others by a shuffle, so that a line of a third of all documents is no one task's.

Defined results: a null or empty text is one empty line; rows with a null doc_id hold no key
and lose no line; rows that repeat a doc_id are one document for the counts, and each row
loses its own lines; a line that stands twice in the document that keeps it stays twice;
dedup() gives a null text as the empty text; an empty table gives an empty result; other
columns are kept by dedup() as they are, but n_lines and n_dropped give way to its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, materialize, mix64, partitions, text_batches, type_of

MIN_CHARS = 40
MIN_DOCS = 5
MAX_FILTER_BYTES = 64 << 20
SHARDS = 64
_LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})


def line_key(line: str) -> str:
    line = line.strip(SPACE)
    return line.lower() if line.isascii() else line.translate(_LOWER)


def digest(key: str) -> bytes:
    return xxhash.xxh3_128_digest(key.encode("utf-8", "surrogatepass"))


class CuckooFilter:
    """Four 16-bit fingerprints to a bucket; insert, delete, contains (of many at once).
    Keys are uint64. It grows by being built anew when an insertion finds no place."""

    SLOTS = 4

    def __init__(self, capacity: int):
        self.buckets = 1 << max(1, math.ceil(math.log2(max(1, capacity) / self.SLOTS / 0.85)))
        self.table = np.zeros((self.buckets, self.SLOTS), dtype=np.uint16)

    def _print(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = mix64(keys.astype(np.uint64))
        f = (h >> np.uint64(48)).astype(np.uint16)
        f = np.where(f == 0, np.uint16(1), f)
        i = (h & np.uint64(self.buckets - 1)).astype(np.int64)
        return f, i, self._other(i, f)

    def _other(self, i, f):
        return i ^ (mix64(np.asarray(f, dtype=np.uint64)) & np.uint64(self.buckets - 1)).astype(np.int64)

    def insert(self, key: int) -> bool:
        f, i, j = (x[0] for x in self._print(np.array([key], dtype=np.uint64)))
        for at in (i, j):
            if (free := np.flatnonzero(self.table[at] == 0)).size:
                self.table[at, free[0]] = f
                return True
        path = []
        for n in range(500):
            slot = n % self.SLOTS
            path.append((i, slot, self.table[i, slot]))
            f, self.table[i, slot] = self.table[i, slot], f
            i = int(self._other(np.array([i]), np.array([f]))[0])
            if (free := np.flatnonzero(self.table[i] == 0)).size:
                self.table[i, free[0]] = f
                return True
        for i, slot, f in reversed(path):  # as it was before
            self.table[i, slot] = f
        return False

    def delete(self, key: int) -> bool:
        f, i, j = (x[0] for x in self._print(np.array([key], dtype=np.uint64)))
        for at in (i, j):
            if (held := np.flatnonzero(self.table[at] == f)).size:
                self.table[at, held[0]] = 0
                return True
        return False

    def contains(self, keys: np.ndarray) -> np.ndarray:
        f, i, j = self._print(keys)
        return ((self.table[i] == f[:, None]) | (self.table[j] == f[:, None])).any(axis=1)

    @classmethod
    def of(cls, keys: np.ndarray) -> CuckooFilter:
        capacity = max(4, len(keys))
        while True:
            made = cls(capacity)
            if all(made.insert(int(k)) for k in keys):
                return made
            capacity = made.buckets * cls.SLOTS

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        made = cls.__new__(cls)
        made.table = np.frombuffer(data, dtype=np.uint16).reshape(-1, cls.SLOTS)
        made.buckets = len(made.table)
        return made


def _keys(text: str | None, min_chars: int) -> set[bytes]:
    return {digest(k) for x in (text or "").split("\n") if len(x) >= min_chars and len(k := line_key(x)) >= min_chars}


def postings(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(h1, h2, doc_id): the long lines of each row, each key once a row."""
    text_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, found = [], []
            for i, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                own = _keys(text, min_chars)
                found += own
                ids += [i] * len(own)
            h = np.frombuffer(b"".join(found), dtype="<i8").reshape(-1, 2)
            yield pd.DataFrame({"h1": h[:, 0], "h2": h[:, 1], "doc_id": pd.Series(ids, dtype=pdf["doc_id"].dtype)})

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter("doc_id is not null")
    return rows.mapInPandas(run, f"h1 long, h2 long, doc_id {type_of(docs, 'doc_id')}")


def _shard() -> Column:
    return F.pmod(F.col("h1"), F.lit(SHARDS)).cast("long")


def built(keys: DataFrame) -> DataFrame:
    """(shard, data): cuckoo filters over keys (h1, h2)."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"shard": pdf["shard"].iloc[:1], "data": [CuckooFilter.of(pdf["h2"].to_numpy().view(np.uint64)).to_bytes()]})

    return keys.select("h2", _shard().alias("shard")).groupBy("shard").applyInPandas(build, "shard long, data binary")


def changed(filters: DataFrame, keys: DataFrame) -> DataFrame:
    """filters (shard, data) after the keys (h1, h2, put) were inserted or, put being false, deleted; a
    filter that has no place left, or a shard without one, has the data null."""

    def run(old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        if not len(old):
            return pd.DataFrame({"shard": new["shard"].iloc[:1], "data": [None]})
        held, put = CuckooFilter.from_bytes(bytes(old["data"].iloc[0])), new["put"].to_numpy().astype(bool)
        h = new["h2"].to_numpy().astype(np.int64).view(np.uint64)
        held.table = held.table.copy()
        for k in h[~put]:
            held.delete(int(k))
        whole = all(held.insert(int(k)) for k in h[put])
        return pd.DataFrame({"shard": old["shard"].iloc[:1], "data": [held.to_bytes() if whole else None]})

    keys = keys.select("h2", "put", _shard().alias("shard"))
    return filters.groupBy("shard").cogroup(keys.groupBy("shard")).applyInPandas(run, "shard long, data binary")


class LineIndex:
    """postings: (h1, h2, doc_id) of all long lines; counts: (h1, h2, n, keeper) of the keys whose
    reference count reaches the limit; filters: (shard, data) over those keys, None while they would be
    over max_filter_bytes. Written tables all."""

    def __init__(self, postings: DataFrame, counts: DataFrame, filters: DataFrame | None, min_chars: int, min_docs: int, max_filter_bytes: int):
        self.postings, self.counts, self.filters = postings, counts, filters
        self.min_chars, self.min_docs, self.max_filter_bytes = min_chars, min_docs, max_filter_bytes

    @classmethod
    def of(cls, docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, max_filter_bytes: int = MAX_FILTER_BYTES) -> LineIndex:
        held = materialize(postings(docs, min_chars).distinct())
        nothing = docs.sparkSession.createDataFrame([], f"h1 long, h2 long, n long, keeper {type_of(docs, 'doc_id')}")
        return cls(held, nothing, None, min_chars, min_docs, max_filter_bytes)._counted(None)

    def _counted(self, touched: DataFrame | None) -> LineIndex:
        """The index with the counts of the touched keys (None: all) taken again, and the filters
        that follow from them."""
        rows = self.postings if touched is None else self.postings.join(touched, ["h1", "h2"], "left_semi")
        now = rows.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper")).filter(F.col("n") >= self.min_docs)
        if touched is not None:
            now = now.union(self.counts.join(touched, ["h1", "h2"], "left_anti").select("h1", "h2", "n", "keeper"))
        now = materialize(now)
        filters, n = None, now.count()
        if 4 * n <= self.max_filter_bytes:
            if self.filters is None:
                filters = materialize(built(now))
            else:
                put = now.select("h1", "h2").join(self.counts, ["h1", "h2"], "left_anti").withColumn("put", F.lit(True))
                gone = self.counts.select("h1", "h2").join(now, ["h1", "h2"], "left_anti").withColumn("put", F.lit(False))
                filters = materialize(changed(self.filters, put.union(gone)))
                full = [r["shard"] for r in filters.filter("data is null").collect()]
                if full:  # SHARDS at most
                    filters = materialize(filters.filter("data is not null").union(built(now.filter(_shard().isin(full)))))
        return LineIndex(self.postings, now, filters, self.min_chars, self.min_docs, self.max_filter_bytes)

    def _with(self, postings: DataFrame) -> LineIndex:
        return LineIndex(postings, self.counts, self.filters, self.min_chars, self.min_docs, self.max_filter_bytes)

    def insert(self, docs: DataFrame) -> LineIndex:
        """The index with the long lines of docs; rows of a doc_id it has add the keys it lacks."""
        new = materialize(postings(docs, self.min_chars).distinct())
        every = materialize(self.postings.union(new).distinct())
        return self._with(every)._counted(new.select("h1", "h2").distinct())

    def delete(self, ids: DataFrame) -> LineIndex:
        """The index without the documents of ids, a table with a column doc_id."""
        ids = ids.select("doc_id").distinct()
        gone = materialize(self.postings.join(ids, "doc_id", "left_semi").select("h1", "h2").distinct())
        return self._with(materialize(self.postings.join(ids, "doc_id", "left_anti").select("h1", "h2", "doc_id")))._counted(gone)

    def candidates(self) -> DataFrame:
        """The postings that the filters let through, all of them where the filters are too large."""
        if self.filters is None:
            return self.postings
        held = self.postings.sparkSession.sparkContext.broadcast({r["shard"]: bytes(r["data"]) for r in self.filters.collect()})

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            cuckoo = {s: CuckooFilter.from_bytes(b) for s, b in held.value.items()}
            for pdf in batches:
                keys, shard = pdf["h2"].to_numpy().view(np.uint64), pdf["h1"].to_numpy() % SHARDS
                keep = np.zeros(len(pdf), dtype=bool)
                for s in np.unique(shard):
                    if s in cuckoo:
                        at = np.flatnonzero(shard == s)
                        keep[at] = cuckoo[s].contains(keys[at])
                yield pdf[keep]

        return self.postings.mapInPandas(run, self.postings.schema)

    def drops(self) -> DataFrame:
        """(doc_id, keys): the keys whose lines each document loses."""
        rows = materialize(self.candidates())
        fair = -(-max(1, rows.count()) // (2 * partitions(rows.sparkSession)))
        counts = self.counts.select("h1", "h2", "n", "keeper")
        hot, rest = F.broadcast(counts.filter(F.col("n") > fair)), counts.filter(F.col("n") <= fair)
        lost = rows.join(hot, ["h1", "h2"]).union(rows.join(hot, ["h1", "h2"], "left_anti").join(rest, ["h1", "h2"])).filter(F.col("doc_id") < F.col("keeper"))
        return lost.groupBy("doc_id").agg(F.collect_list(F.struct("h1", "h2")).alias("keys"))


def dedup(docs: DataFrame, index: LineIndex) -> DataFrame:
    """docs with text replaced by what is kept, and the added columns n_lines, n_dropped."""
    text_batches(docs.sparkSession)
    names, min_chars = docs.columns, index.min_chars
    drops = index.drops().select(F.col("doc_id").alias("__id"), F.transform("keys", lambda k: k["h1"]).alias("__h1"), F.transform("keys", lambda k: k["h2"]).alias("__h2"))
    joined = docs.join(drops, F.col("doc_id") == F.col("__id"), "left").drop("__id")
    text = F.col("text").cast("string")

    def kept(text: pd.Series, h1: pd.Series, h2: pd.Series) -> pd.DataFrame:
        out = []
        for t, a, b in zip(text, h1, h2, strict=True):
            lines = (t or "").split("\n")
            n = len(lines)
            if a is not None and len(a):
                lost = {bytes(x) for x in np.stack([np.asarray(a, dtype="<i8"), np.asarray(b, dtype="<i8")], axis=1)}
                lines = [x for x in lines if len(x) < min_chars or digest(line_key(x)) not in lost]
            out.append(("\n".join(lines), n, n - len(lines)))
        return pd.DataFrame(out, columns=["text", "n_lines", "n_dropped"])

    apply = F.pandas_udf(kept, "text string, n_lines long, n_dropped long")
    joined = joined.withColumn("__kept", apply(text, F.col("__h1"), F.col("__h2")))
    own = ("n_lines", "n_dropped")
    kept_columns = [F.col("__kept.text").alias(c) if c.lower() == "text" else F.col(f"`{c}`") for c in names if c.lower() not in own]
    return joined.select(*kept_columns, *[F.col(f"__kept.{c}").alias(c) for c in own])
