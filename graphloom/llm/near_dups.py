"""MinHash near-dedup with fast similarity sketching, banding and exact verification.

Sketch: t bins. In round i < t every shingle is hashed to a bin and a value, in round
i >= t to bin i - t; a bin keeps its smallest (round, value). Rounds go on until every bin is
filled, after 2t at the latest, so each coordinate of two sets agrees with the probability
of their Jaccard similarity, and sketching n shingles costs about n + t log t hashes.

Banding: BANDS bands of ROWS coordinates. A pair at similarity 0.8 shares no band with a
probability of (1 - 0.8^6)^56, about 4e-8.

Equal sets are one class, represented by its smallest doc_id. Every member of a bucket is
compared with the bucket's hub, its most central member (the one that shares most buckets
with others), and the links make components. A pair x, y of a bucket that is still apart can
only be linked if their differences from the hub h overlap: with D = set ^ h, x ^ y = Dx ^ Dy, and
a link needs |x ^ y| <= (|x| + |y|) / 9, so |Dx & Dy| >= o = (|Dx| + |Dy| - (|x| + |y|) / 9) / 2. (o is above 0,
as one of the two is not linked to h.) Hence their first common shingle, in any order of
the group's shingles, has at least o shingles from it on in Dx and in Dy. The order has those
outside the hub first, but last of all those that many differences hold: what a group shares and its
hub lost to an edit would join all its members. The former are rare, and if either document has
fewer than o others, the first common shingle is one of them. Pairs come from a join on
these short prefixes, and share a bucket: a mask holds the bands in which a member meets the hub
(h is the hub there, so two members meet each other wherever their masks do). No link of a
bucket is lost, and pairs inside a component or a loose group are not made. Every link is confirmed
on the full sets of the texts.

Defined results: a text of fewer words than a shingle is one shingle; a text without words
(null, empty, white space) has no shingles and no links; rows with a null doc_id take no
part (component_id null, kept true); rows that share a doc_id count as one document; each row
is returned; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fair_join, materialize, mix64, text_batches, type_of
from .components import connected_components
from .fingerprints import only

ROWS, BANDS = 6, 56
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 80
#: A shingle is frequent in a part of a group, of PART members at least, if so many differences, and one in so many, hold it.
PART, OFTEN, ONE_IN = 32, 8, 16
#: Text that a worker sketches at once.
CHUNK = 2 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingles(text: str | None, width: int) -> np.ndarray:
    """The sorted distinct hashes of the shingles of a whole text. bytes.lower and bytes.split
    know only ASCII letters and the six ASCII white-space characters."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    if not len(h):
        return h
    n = min(width, len(h))
    out = np.full(len(h) - n + 1, n, dtype=np.uint64)
    for j in range(n):
        out = mix64(out * _ODD + h[j : len(h) - n + 1 + j])
    return np.unique(out)


def sketch(sets: list[np.ndarray], t: int) -> np.ndarray:
    """(len(sets), t) coordinates; empty sets have none that count."""
    out = np.full((len(sets), t), _EMPTY, dtype=np.uint64)
    alive = np.array([i for i, s in enumerate(sets) if len(s)], dtype=np.int64)
    if not len(alive):
        return out
    flat = np.concatenate([sets[i] for i in alive])
    sizes = np.array([len(sets[i]) for i in alive], dtype=np.int64)
    owner = np.repeat(alive, sizes)
    cells = out.reshape(-1)
    for i in range(2 * t):
        h = mix64(flat + np.uint64((i + 1) * int(_ODD) % 2**64))
        value = np.uint64(i) << np.uint64(32) | h >> np.uint64(32)
        place = (h & np.uint64(0xFFFFFFFF)) * np.uint64(t) >> np.uint64(32) if i < t else np.uint64(i - t)
        np.minimum.at(cells, owner * t + place.astype(np.int64), value)
        open_ = (out[alive] == _EMPTY).any(axis=1)
        if not open_.all():
            keep = np.repeat(open_, sizes)
            alive, sizes, flat, owner = alive[open_], sizes[open_], flat[keep], owner[keep]
            if not len(alive):
                break
    return out


def bands(coordinates: np.ndarray, rows: int, n_bands: int) -> np.ndarray:
    c = coordinates.reshape(len(coordinates), n_bands, rows)
    h = np.broadcast_to(np.arange(1, n_bands + 1, dtype=np.uint64), c.shape[:2])
    for j in range(rows):
        h = mix64(h * _ODD + c[:, :, j])
    return h.view(np.int64)


def signatures(docs: DataFrame, width: int, rows: int = ROWS, n_bands: int = BANDS) -> DataFrame:
    """doc_id, n (size of the set), h1, h2 (digest of the set), bands."""

    text_batches(docs.sparkSession)
    def chunk(ids: list, texts: list) -> pd.DataFrame:
        sets = [shingles(t, width) for t in texts]
        h = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), dtype="<i8").reshape(-1, 2)
        b = bands(sketch(sets, rows * n_bands), rows, n_bands)
        return pd.DataFrame({"doc_id": ids, "n": [len(s) for s in sets], "h1": h[:, 0], "h2": h[:, 1], "bands": list(b)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            start, size = 0, 0
            for k, text in enumerate(pdf["text"]):
                size += len(text or "")
                if size >= CHUNK or k == len(pdf) - 1:
                    part = pdf.iloc[start : k + 1]
                    yield chunk(part["doc_id"], part["text"])
                    start, size = k + 1, 0

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInPandas(run, f"doc_id {type_of(docs, 'doc_id')}, n long, h1 long, h2 long, bands array<long>")


def compare(pairs: DataFrame, texts: DataFrame, width: int, percent: int = PERCENT) -> DataFrame:
    """a, b, mask, linked, and of a's difference from b: d its size, rare how many of its shingles b lacks
    and often does not name, na, nb the sizes of the sets, prefix as many of its shingles as a link could
    need, the rare ones first and those in often last. pairs: a, b, mask, often (null: none);
    texts: id, text."""
    text_batches(texts.sparkSession)
    kind = type_of(texts, "id")
    share = (100 - percent) / (100 + percent)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, own = None, None
        for pdf in batches:
            out = []
            for a, b, mask, often, ta, tb in zip(pdf["a"], pdf["b"], pdf["mask"], pdf["often"], pdf["ta"], pdf["tb"], strict=True):
                if last != (b, tb):
                    last, own = (b, tb), shingles(tb, width)
                other = shingles(ta, width)
                at = np.minimum(np.searchsorted(own, other), len(own) - 1)
                held = own[at] == other
                both = int(held.sum())
                lost = np.ones(len(own), dtype=bool)
                lost[at[held]] = False
                most = int(share * len(other) * (1 + 100 / percent)) + 2
                new, rest = other[~held], own[lost]
                if often is not None and len(often):
                    late = np.asarray(often, dtype=np.int64).view(np.uint64)
                    worn, gone = np.isin(new, late), np.isin(rest, late)
                    new, rest = new[~worn], np.concatenate([rest[~gone], new[worn], rest[gone]])
                prefix = np.concatenate([new, rest])[:most].view(np.int64)
                n = len(own) + len(other)
                out.append((a, b, mask, 100 * both >= percent * (n - both), n - 2 * both, len(new), len(other), len(own), prefix))
            yield pd.DataFrame(out, columns=["a", "b", "mask", "linked", "d", "rare", "na", "nb", "prefix"])

    ta, tb = (texts.select(F.col("id").alias(x), F.col("text").alias(f"t{x}")) for x in "ab")
    return pairs.join(ta, "a").join(tb, "b").select("a", "b", "mask", "often", "ta", "tb").mapInPandas(run, f"a {kind}, b {kind}, mask long, linked boolean, d long, rare long, na long, nb long, prefix array<long>")


def frequent(apart: DataFrame) -> DataFrame:
    """b, often: the shingles that many of the differences from hub b hold. apart: a, b, m members
    of the group, prefix. Parts of a group are counted where they lie, a large group in several tasks, and
    only shingles frequent in a part leave it, so one may be missed: the order is as exact without it.
    At most 2 * ONE_IN mean prefixes of the group, about eight sets of shingles."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hub, held = None, []

        def counted() -> pd.DataFrame:
            tokens, c = np.unique(np.concatenate(held), return_counts=True)
            hit = c >= max(OFTEN, len(held) / ONE_IN)
            return pd.DataFrame({"b": [hub] * int(hit.sum()), "token": tokens[hit], "c": c[hit]})

        for pdf in batches:
            for b, prefix in zip(pdf["b"], pdf["prefix"], strict=True):
                if b != hub:
                    if len(held) >= PART:
                        yield counted()
                    hub, held = b, []
                held.append(np.asarray(prefix, dtype=np.int64))
        if len(held) >= PART:
            yield counted()

    large = apart.filter(f"m >= {PART}")
    dealt = large.select("a", "b", "prefix").repartitionByRange("b", F.xxhash64("a")).sortWithinPartitions("b").select("b", "prefix")
    counts = dealt.mapInPandas(run, f"b {type_of(apart, 'b')}, token long, c long").groupBy("b", "token").agg(F.sum("c").alias("c"))
    return counts.join(large.groupBy("b").agg(F.first("m").alias("m")), "b").filter(f"{2 * ONE_IN} * c >= m").groupBy("b").agg(F.collect_list("token").alias("often"))


def near_links(docs: DataFrame, sig: DataFrame, width: int, rows: int = ROWS, n_bands: int = BANDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(classes, components): classes h1, h2, rep; components id, component of those
    representatives that have links. sig: a written table of signatures()."""
    if n_bands > 64:
        raise ValueError("a mask has 64 bands")
    here = sig.filter("doc_id is not null and n > 0")
    classes = here.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"))
    # dealt by the ids: by the digests, all copies of a text would go to one task
    reps = here.join(classes.select("h1", "h2", F.col("rep").alias("doc_id")).repartition("doc_id"), ["h1", "h2", "doc_id"])
    reps = materialize(reps.select(F.col("doc_id").alias("rep"), "bands"))
    members = reps.select(F.posexplode("bands").alias("band", "key"), "rep")
    sizes = members.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    # as large as the input at any size: never worth a broadcast
    shared = materialize(members.hint("merge").join(sizes, "key"))
    central = shared.groupBy("rep").agg(F.sum("size").alias("shared"))
    hubs = shared.join(central, "rep").groupBy("key").agg(F.max_by("rep", F.struct("shared", "rep")).alias("hub"))
    beside = shared.join(hubs, "key").filter("rep <> hub").groupBy(F.col("rep").alias("a"), F.col("hub").alias("b"))
    pairs = materialize(beside.agg(F.expr("bit_or(shiftleft(1L, band))").alias("mask")))
    ids = materialize(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
    whole = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text"))
    texts = materialize(only(whole, "id", ids).hint("merge").join(ids, "id"))
    none = F.lit(None).cast("array<long>").alias("often")
    star = materialize(compare(pairs.select("*", none), texts, width, percent))
    links = star.filter("linked").select("a", "b")
    found = materialize(connected_components(links))
    label = found.select(F.col("id").alias("a"), "component")
    labelled = lambda df: df.select("a", "b", "mask", "d", "rare", "na", "prefix").join(label, "a", "left").withColumn("component", F.coalesce("component", "a"))
    apart = labelled(star)
    loose = apart.groupBy("b").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.count("*").alias("m")).filter("c0 <> c1").select("b", "m")
    apart = materialize(apart.join(loose, "b"))
    often = materialize(frequent(apart))
    again = materialize(compare(apart.select("a", "b", "mask").join(often, "b"), texts, width, percent))
    apart = apart.drop("m").join(often.select("b"), "b", "left_anti").unionByName(labelled(again))
    tokens = apart.select("b", "a", "mask", "d", "rare", "na", "component", F.posexplode("prefix").alias("pos", "token"))
    other = tokens.select("b", "token", F.col("a").alias("y"), F.col("mask").alias("my"), F.col("d").alias("dy"), F.col("rare").alias("wy"), F.col("na").alias("ny"), F.col("component").alias("cy"), F.col("pos").alias("py"))
    least = f"{100 + percent} * (d + dy) - {100 - percent} * (na + ny)"
    near = f"component < cy and (mask & my) <> 0 and 2 * {100 + percent} * (d - pos) >= {least} and 2 * {100 + percent} * (dy - py) >= {least} and 100 * least(na, ny) >= {percent} * greatest(na, ny)"
    near += f" and (pos < rare or 2 * {100 + percent} * least(d - rare, dy - wy) >= {least})"
    more = materialize(tokens.join(other, ["b", "token"]).filter(near).select("a", F.col("y").alias("b"), F.lit(0).cast("long").alias("mask")).distinct())
    late = materialize(compare(more.select("*", none), texts, width, percent).filter("linked").select("a", "b"))
    if not late.isEmpty():
        found = materialize(connected_components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).union(late)))
    return classes, found


def components(docs: DataFrame, width: int = 5, rows: int = ROWS, n_bands: int = BANDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text)."""
    sig = materialize(signatures(docs, width, rows, n_bands))
    classes, found = near_links(docs, sig, width, rows, n_bands, percent)
    classes = classes.join(found.select(F.col("id").alias("rep"), "component"), "rep", "left").withColumn("rep", F.coalesce("component", "rep"))
    classes = materialize(classes.select("h1", "h2", "rep"))
    out = fair_join(sig.select("doc_id", "n", "h1", "h2"), classes, "h1", "h2", how="left")
    component = F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.col("rep"))).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
