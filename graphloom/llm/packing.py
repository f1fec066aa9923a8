"""Best-fit packing of tokenised documents into fixed-length sequences.

Linear grouping: the large lengths are dealt into groups of equal cardinality and rounded
up to the longest of their group; configurations (how many of each rounded size make a
sequence) are chosen over these few sizes; the actual documents then take the slots of
their group, and the small lengths go, longest first, where they fit best.

Lengths are whole numbers up to the capacity, so the histogram of lengths is bounded by the
capacity whatever the corpus holds. Only that histogram, and as many salted counts as
there are shuffle partitions, come to the driver; documents get their place from
(length, rank within the length), without a shuffle of texts.

Defined results: a null or empty text is the closing id alone (one piece of length 1); a
longer document is cut from its end, so that only the first piece may be shorter; repeated
rows and repeated or null ids are packed row by row; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import base64
import bisect
import math
import zlib
from collections import Counter, deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, partitions, text_batches, type_of

CAPACITY = 2048
#: Lengths above this share of the capacity are large.
LARGE = 1 / 8
#: Numbers of groups that are tried; the plan with the fewest sequences is taken.
GROUPS = (16, 32, 64, 128, 256, 512, 1024, 2048)
#: Split pattern of the byte-level vocabulary (a fixed value of the public tokenizer).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPECIAL = "<|endoftext|>"

_encoders: dict[tuple[str, str], Callable[[str], list[int]]] = {}


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoder(json_path: str, ranks_path: str) -> Callable[[str], list[int]]:
    """Text to ids of the tokenizer in json_path. The same vocabulary as ranks encodes
    about four times as fast; texts that hold the special token, where the two differ, and
    texts that the faster library refuses go to the tokenizer itself."""
    if (key := (json_path, ranks_path)) not in _encoders:
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f)}
        fast = tiktoken.Encoding("byte_bpe_50k", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        slow: list = []

        def encode(text: str) -> list[int]:
            if SPECIAL not in text:
                try:
                    return fast.encode_ordinary(text)
                except ValueError:
                    pass
            if not slow:
                from tokenizers import Tokenizer

                slow.append(Tokenizer.from_file(json_path))
            return slow[0].encode(text, add_special_tokens=False).ids

        _encoders[key] = encode
    return _encoders[key]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens."""
    first = n % capacity or capacity
    return [(0, min(n, first)), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, capacity: int = CAPACITY, paths: tuple[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: id, piece, start, length, ids_crc32."""
    text_batches(docs.sparkSession)
    paths = paths or default_paths()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(*paths)
        for pdf in batches:
            out: list[tuple] = []
            for i, text in zip(pdf["id"], pdf["text"], strict=True):
                ids = np.array([*encode(text or ""), 0], dtype="<u4")
                out += [(i, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(cut(len(ids), capacity))]
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": pdf["id"].dtype})

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInPandas(run, f"doc_id {type_of(docs, id_col)}, piece int, start long, length long, ids_crc32 long")


def _grouped(large: list[tuple[int, int]], k: int) -> list[tuple[int, deque]]:
    """(rounded size, its runs of (length, count)), in groups of equal cardinality, the longest first."""
    each = max(1, math.ceil(sum(c for _, c in large) / k))
    groups: list[tuple[int, deque]] = []
    room = 0
    for n, c in large:
        while c:
            if not room:
                groups.append((n, deque()))
                room = each
            take = min(c, room)
            groups[-1][1].append([n, take])
            c, room = c - take, room - take
    merged: dict[int, deque] = {}
    for n, runs in groups:
        merged.setdefault(n, deque()).extend(runs)
    return list(merged.items())


def _fullest(sizes: list[int], left: list[int], room: int) -> list[int]:
    """Indices (repeats counted) of the sizes that fill room best."""
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for i, (s, c) in enumerate(zip(sizes, left, strict=True)):
        for _ in range(min(c, room // s)):
            steps.append((i, s, reach))
            if (more := (reach | reach << s) & mask) == reach:
                steps.pop()
                break
            reach = more
        if reach >> room & 1:
            break
    at, out = reach.bit_length() - 1, []
    for i, s, before in reversed(steps):
        if not before >> at & 1:
            out.append(i)
            at -= s
    return out


def _configurations(sizes: list[int], left: list[int], capacity: int) -> list[tuple[list[int], int]]:
    """(indices of sizes, how many sequences): each takes the largest size that is left and what fills it best."""
    out, left, first = [], list(left), 0
    while first < len(sizes):
        if not left[first]:
            first += 1
            continue
        left[first] -= 1
        items = [first, *_fullest(sizes, left, capacity - sizes[first])]
        left[first] += 1
        use = Counter(items)
        times = min(left[i] // m for i, m in use.items())
        for i, m in use.items():
            left[i] -= m * times
        out.append((items, times))
    return out


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY, groups: int = 64) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a sequence, number of such sequences) that hold all of counts."""
    sizes = sorted(((n, c) for n, c in counts.items() if c), reverse=True)
    grouped = _grouped([x for x in sizes if x[0] > capacity * LARGE], groups)
    bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}  # by the room left
    for items, times in _configurations([n for n, _ in grouped], [sum(c for _, c in runs) for _, runs in grouped], capacity):
        slots = []
        for i in items:  # the group's actual documents, in order
            runs, need = grouped[i][1], times
            slot: deque = deque()
            while need:
                take = min(need, runs[0][1])
                slot.append([runs[0][0], take])
                runs[0][1] -= take
                need -= take
                if not runs[0][1]:
                    runs.popleft()
            slots.append(slot)
        while slots[0]:
            n = min(s[0][1] for s in slots)
            held = tuple(s[0][0] for s in slots)
            bins.setdefault(capacity - sum(held), []).append((held, n))
            for s in slots:
                s[0][1] -= n
                if not s[0][1]:
                    s.popleft()
    rooms = sorted(bins)

    def put(room: int, held: tuple[int, ...], n: int) -> None:
        if room not in bins:
            bisect.insort(rooms, room)
            bins[room] = []
        bins[room].append((held, n))

    for size, count in (x for x in sizes if x[0] <= capacity * LARGE):
        while count:
            k = bisect.bisect_left(rooms, size)
            if k == len(rooms):
                room, held, n = capacity, (), math.ceil(count / (capacity // size))
            else:
                room = rooms[k]
                held, n = bins[room].pop()
                if not bins[room]:
                    del bins[room], rooms[k]
            each = min(room // size, count)
            full = min(n, count // each)  # a sequence that took one stays the tightest that fits
            put(room - each * size, (*held, *[size] * each), full)
            if n > full and held:
                put(room, held, n - full)
            elif n > full:
                n = full
            count -= full * each
    return [x for room in rooms for x in bins[room]]


def best_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    least = math.ceil(sum(n * c for n, c in counts.items()) / capacity)
    best: list | None = None
    for k in GROUPS:
        plan = plan_bins(counts, capacity, k)
        if best is None or sum(n for _, n in plan) < sum(n for _, n in best):
            best = plan
        if sum(n for _, n in best) <= least:
            break
    return best or []


def segments(plan: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """Where the ranks of each length go: from rank `rank` of length `length` on, to the
    sequences from `sequence` on, at `offset`."""
    ranks: Counter = Counter()
    rows, sequence = [], 0
    for held, n in plan:
        offset = 0
        for size in held:
            rows.append((size, ranks[size], sequence, offset))
            ranks[size] += n
            offset += size
        sequence += n
    rows.sort()
    a = np.array(rows, dtype=np.int64).reshape(-1, 4)
    return {"key": a[:, 0] << 44 | a[:, 1], "rank": a[:, 1], "sequence": a[:, 2], "offset": a[:, 3]}


def place(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give each row of pieces() its sequence_id and offset. rows must be a written table."""
    spark = rows.sparkSession
    counts = {r[0]: r[1] for r in rows.groupBy("length").count().collect()}  # at most `capacity` rows
    total, share = sum(counts.values()), 2 * partitions(spark)
    target = max(64, total // share)  # a length that many documents have is dealt out to several tasks
    salts = {n: math.ceil(c / target) for n, c in counts.items()}
    first, at = np.zeros(capacity + 1, dtype=np.int64), 0
    for n in sorted(salts):
        first[n], at = at, at + salts[n]
    few = spark.createDataFrame([(n, s) for n, s in salts.items()], "length long, __salts long")
    order = F.xxhash64("doc_id", "piece", "start", "ids_crc32")
    salted = rows.join(F.broadcast(few), "length").withColumn("__order", order).withColumn("__salt", F.expr("pmod(__order, __salts)"))
    base = np.zeros(at, dtype=np.int64)
    for n, s, c in salted.groupBy("length", "__salt").count().collect():  # at most capacity + 2 * partitions rows
        base[first[n] + s] = c
    for n, s in salts.items():
        own = base[first[n] : first[n] + s]
        own[:] = np.cumsum(own) - own
    where = spark.sparkContext.broadcast((segments(best_plan(counts, capacity)), first, base))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, first, base = where.value
        for pdf in batches:
            n = pdf["length"].to_numpy()
            rank = base[first[n] + pdf.pop("__salt").to_numpy()] + pdf.pop("__rank").to_numpy() - 1
            k = np.searchsorted(at["key"], n.astype(np.int64) << 44 | rank, side="right") - 1
            yield pdf.assign(sequence_id=at["sequence"][k] + rank - at["rank"][k], offset=at["offset"][k])

    ranked = salted.withColumn("__rank", F.row_number().over(Window.partitionBy("length", "__salt").orderBy("__order", "doc_id", "piece", "start", "ids_crc32")).cast("long"))
    kept = [c for c in rows.columns]
    schema = ", ".join(f"`{c}` {type_of(rows, c)}" for c in kept)
    return ranked.select(*kept, "__salt", "__rank").mapInPandas(run, f"{schema}, sequence_id long, offset long")


def pack(docs: DataFrame, capacity: int = CAPACITY, paths: tuple[str, str] | None = None) -> DataFrame:
    """Pack docs (doc_id, text) into sequences: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return place(materialize(pieces(docs, capacity, paths)), capacity)
