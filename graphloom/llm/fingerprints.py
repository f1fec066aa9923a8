"""Document fingerprints after I-Match, in DataFrame functions only.

The lexicon holds the terms whose inverse document frequency lies in a band: a term is kept
if at least LOW of all documents (and two documents) hold it, and at most HIGH of all copy
classes, so that a group of copies, however large, cannot push its own words out. A row is of the
class of the most frequent of its KEYS keys (least hashes of word trigrams) if SHARED of them are
keys of LOW of all documents, and a class of its own otherwise. A document's
distinct lexicon terms are sorted and hashed once for each of 28 random subsets of the
lexicon: 4 draws at the rate 1/4, and two draws inside each of them at the rates 1/16, 1/64 and 1/256,
so that short and long documents both have subsets that hold a few of their terms, and a term is
looked at about seven times. A fingerprint is the 28 hashes; likeness is the share of equal hashes among
the subsets that hold a term of either document.

At most (mean distinct terms of a document) / LOW terms can reach the band's lower end, however
large the corpus is. The lexicon reaches the rows as a Bloom filter of TERM_BITS bits a term or more
(16 MB at most, enough for a million terms), a scalar subquery, so documents are never exploded to be
matched. Of the terms outside the band it lets one in 4,000 through or fewer; such a term is one
more lexicon term, the same one in every document.

Terms are hashed before they are sorted; the order is that of their hashes.

Defined results: a null text is the empty text; a text with fewer than FEW lexicon terms is hashed
over those and, up to FEW in all, its other terms with the least hashes, so that one lexicon
term more or less moves one other term; the empty text is hashed over none, and two texts without any term have likeness 1;
rows with a null doc_id come first, rows that share one are ordered by text; ids of any type stand in
the order of their own values; the row after the last is the first, so a single row follows
itself; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import number
from ..sources.scratch import discard
from .common import GAP, materialize, partitions

#: The band, as shares of all documents.
LOW, HIGH = 1 / 2000, 1 / 10
TERM_BITS, MAX_FILTER_BITS = 128, 27
#: Lexicon terms below which a document's other terms fill up.
FEW = 8
#: Keys of a row, by which copies are found, and how many of them must be frequent.
KEYS, SHARED = 4, 2
#: Draws at the rate 1/4, draws inside each of them, and their rates 2^-r; each step takes two bits of
#: the term's hash of its own, 56 in all.
OUTER, INNER, RATES = 4, 2, (4, 6, 8)
HASHES = OUTER * (1 + INNER * len(RATES))
EMPTY = "0" * 8


def terms(text: str) -> str:
    """SQL for the sorted distinct 64-bit hashes of a text's terms."""
    gap = GAP.replace("\\", "\\\\")
    return f"sort_array(array_distinct(transform(filter(split(lower({text}), '{gap}'), w -> w <> ''), w -> xxhash64(w))))"


def keyed(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The distinct terms and the keys k0, k1, ... of each row."""
    gap = GAP.replace("\\", "\\\\")
    words = f"transform(filter(split(lower(coalesce(cast(`{text_col}` as string), '')), '{gap}'), w -> w <> ''), w -> xxhash64(w))"
    rows = docs.select(F.expr(words).alias("w")).select("w", F.expr("transform(w, (t, i) -> xxhash64(t, get(w, i + 1), get(w, i + 2)))").alias("g"))
    return rows.select(F.array_distinct("w").alias("terms"), *[F.expr(f"array_min(filter(g, x -> x & {KEYS - 1} = {j}))").alias(f"k{j}") for j in range(KEYS)])


def copy_classes(rows: DataFrame, n_docs: int, low: float = LOW) -> DataFrame:
    """The terms of keyed() rows, and class: equal in the near copies of a group, null in a row that is
    of no group of LOW of all documents. At most KEYS / LOW keys are frequent; they are broadcast."""
    keys = [f"k{j}" for j in range(KEYS)]
    often = rows.select(F.explode(F.array(*keys)).alias("k")).filter("k is not null").groupBy("k").agg(F.count("*").alias("n"))
    often = materialize(often.filter((F.col("n") >= 2) & (F.col("n") >= low * n_docs)))
    for j, k in enumerate(keys):
        rows = rows.join(F.broadcast(often.select(F.col("k").alias(k), F.struct("n", "k").alias(f"n{j}"))), k, "left")
    held = [f"n{j}" for j in range(KEYS)]
    frequent = sum(F.col(h).isNotNull().cast("int") for h in held)
    return rows.select("terms", F.when(frequent >= SHARED, F.greatest(*held)["k"]).alias("class"))


def lexicon(docs: DataFrame, text_col: str = "text", low: float = LOW, high: float = HIGH) -> DataFrame:
    """term (its hash), n: the terms in the band. Aggregations with partial counts; a null term
    in each row counts the rows and classes."""
    n_docs = docs.count()
    written = materialize(keyed(docs, text_col))
    rows = copy_classes(written, n_docs, low)
    held = rows.select(F.explode(F.concat("terms", F.array(F.lit(None).cast("long")))).alias("term"), "class").groupBy("term", "class").agg(F.count("*").alias("n"))
    held = held.groupBy("term").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("class").isNull(), F.col("n")).otherwise(1)).alias("classes"))
    held = materialize(held.filter(F.col("term").isNull() | (F.col("n") >= 2) & (F.col("n") >= low * n_docs)))
    discard(written)
    most = high * F.coalesce(held.filter("term is null").agg(F.max("classes").alias("n")).scalar(), F.lit(0))
    return held.filter(F.col("term").isNotNull() & (F.col("classes") <= most)).select("term", "n")


def filter_bits(n: int) -> int:
    return min(MAX_FILTER_BITS, max(12, math.ceil(math.log2(TERM_BITS * max(1, n)))))


def bloom(lex: DataFrame, bits: int) -> Column:
    """The lexicon as an array of 2^bits / 64 words, a scalar subquery; two bits a term."""
    spark = lex.sparkSession
    slot = F.explode(F.array(F.col("term").bitwiseAND(F.lit((1 << bits) - 1)), F.expr(f"shiftrightunsigned(term, {64 - bits})")))
    words = lex.select(slot.alias("slot")).groupBy(F.expr("shiftrightunsigned(slot, 6)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("held"))
    every = spark.range(1 << (bits - 6)).join(words, F.col("id") == F.col("word"), "left").select("id", F.coalesce("held", F.lit(0).cast("long")).alias("held"))
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "held"))), lambda x: x["held"])).scalar()


def _in(filter_col: str, bits: int) -> str:
    probe = "bit_get(get({f}, cast(shiftrightunsigned({s}, 6) as int)), cast({s} & 63 as int)) = 1"
    return " and ".join(probe.format(f=filter_col, s=s) for s in (f"(t & {(1 << bits) - 1})", f"shiftrightunsigned(t, {64 - bits})"))


def only(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """rows without most of those whose key is not in ids (one column of that name), ahead of an
    exact join: a Bloom filter of 16 bits an id, 2^27 bits (16 MB) at most. ids: a written table."""
    bits = min(27, max(12, math.ceil(math.log2(16 * max(1, ids.count())))))
    held = bloom(ids.select(F.xxhash64(key).alias("term")), bits)
    return rows.withColumn("t", F.xxhash64(key)).withColumn("__f", held).filter(F.expr(_in("__f", bits))).drop("t", "__f")


def fingerprint(df: DataFrame, text: str, lex_filter: Column, name: str, bits: int) -> DataFrame:
    """df with the fingerprint of the column text as the added column name."""
    out = df.withColumn("__all", F.expr(terms(f"`{text}`"))).withColumn("__lex", lex_filter)
    out = out.withColumn("__in", F.expr(f"filter(__all, t -> {_in('__lex', bits)})")).drop("__lex")
    # by a hash of their own, as draws take their bits from that of the term
    others = "transform(array_sort(transform(array_except(__all, __in), t -> struct(xxhash64(t, -1) as o, t as t))), x -> x.t)"
    filled = F.expr(f"sort_array(concat(__in, slice({others}, 1, {FEW} - size(__in))))")
    out = out.withColumn("__s", F.when(F.size("__in") < FEW, filled).otherwise(F.col("__in")))
    held, bit = ["__s"], 0

    def draw(prior: str) -> str:
        nonlocal out, bit
        held.append(f"__s{len(held)}")
        out = out.withColumn(held[-1], F.expr(f"filter({prior}, t -> t & {3 << bit}L = 0)"))
        bit += 2
        return held[-1]

    for _ in range(OUTER):
        outer = draw("__s")
        for _ in range(INNER):
            prior = outer
            for _ in RATES:
                prior = draw(prior)
    hashes = [F.expr(f"if(size({s}) = 0, '{EMPTY}', right(lpad(hex(xxhash64({s})), 16, '0'), 8))") for s in held[1:]]
    return out.withColumn(name, F.lower(F.concat(*hashes))).drop("__all", "__in", *held)


def likeness(a: str, b: str) -> Column:
    """The share of equal hashes among the subsets that either document has terms in."""
    either = f"filter(sequence(0, {HASHES - 1}), i -> substr({a}, 8 * i + 1, 8) <> '{EMPTY}' or substr({b}, 8 * i + 1, 8) <> '{EMPTY}')"
    same = f"filter(sequence(0, {HASHES - 1}), i -> substr({a}, 8 * i + 1, 8) <> '{EMPTY}' and substr({a}, 8 * i + 1, 8) = substr({b}, 8 * i + 1, 8))"
    return F.expr(f"if({a} = {b}, 1.0D, coalesce(size({same}) / nullif(size({either}), 0), 1.0D))")


def with_next(rows: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """rows with next_<column> of the row after it by id_col, the first after the last.

    Ids alone are numbered first, by a range sort, so that the rows can be dealt to ranges of equal
    sizes (four for each partition), whose bounds are ids: the first of each range. A row finds its range by a
    look-up in two steps of about the square root of their number; the first rows of a range also go,
    marked, to the range before it, so one shuffle of whole rows is all and no window spans the table."""
    key = F.col(id_col)
    ids = materialize(number(rows.select(key.alias("k")).filter("k is not null"), [F.col("k")], "at"))
    n_ids = ids.count()
    ranges = min(max(1, n_ids), 4 * partitions(rows.sparkSession))
    starts = materialize(ids.filter(F.expr(f"at = 0 or (at * {ranges}) div {max(1, n_ids)} <> ((at - 1) * {ranges}) div {max(1, n_ids)}")).select("k").distinct())
    n = max(1, starts.count())
    step = max(1, math.isqrt(n))
    few = starts.agg(F.sort_array(F.collect_list("k")).alias("b"))
    few = few.select(F.struct("b", F.expr(f"filter(b, (x, i) -> i % {step} = {step - 1})").alias("coarse"))).scalar()
    out = rows.withColumns({"__key": key, "__few": few})
    before = F.expr(f"size(filter(__few.coarse, x -> x <= __key)) * {step}")
    out = out.withColumn("__before", before).withColumn("__range", F.expr(f"if(__key is null, 0, __before + size(filter(slice(__few.b, __before + 1, {step}), x -> x <= __key)) - 1)"))
    has_null = not rows.filter(key.isNull()).isEmpty()
    first = F.coalesce(F.expr("get(__few.b, __range) = __key"), F.lit(False))
    to = F.when(F.col("__key").isNull(), n - 1).when(first & (F.col("__range") > 0), F.col("__range") - 1)
    if not has_null:
        to = to.when(first, n - 1)
    out = out.withColumn("__to", to).drop("__few", "__before")
    here, there = (F.struct(F.col(c).alias("r"), F.lit(k).alias("extra")) for k, c in enumerate(("__range", "__to")))
    out = out.withColumn("__copy", F.explode(F.when(F.col("__to").isNull(), F.array(here)).otherwise(F.array(here, there))))
    w = Window.partitionBy("__copy.r").orderBy("__copy.extra", F.col("__key").asc_nulls_first(), *columns)
    out = out.withColumns({f"next_{c}": F.lead(c).over(w) for c in columns}).filter("__copy.extra = 0")
    return out.drop("__copy", "__range", "__to", "__key")


def compare_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    held = materialize(lexicon(rows))
    bits = filter_bits(held.count())
    lex = bloom(held, bits)
    rows = with_next(fingerprint(rows, "text", lex, "fingerprint", bits), "doc_id", ["text", "fingerprint"])
    half = F.expr("cast(floor(char_length(text) / 2) as int)")
    edited = F.concat(F.expr("substring(text, 1, char_length(text) - cast(floor(char_length(text) / 2) as int))"), F.substring("next_text", F.lit(1), half))
    rows = fingerprint(rows.withColumn("edited", edited), "edited", lex, "edited_fingerprint", bits)
    return rows.select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint", "edited_fingerprint", likeness("fingerprint", "edited_fingerprint").alias("near_edited"), likeness("fingerprint", "next_fingerprint").alias("near_next"),
    )
