"""PII by information-theoretic sanitisation.

Base spans are direct identifiers, found by rule: e-mail addresses, IP addresses, card and
phone numbers. Three kinds of facts are protected: that a text holds an identifier of a class
(an address, a card, ...), the identifier itself, and, as the names of people and firms are, its parts.
Terms that stand beside them may reveal them: for a protected entity e and a term t,
PMI(e; t) = log2(N n(e,t) / (n(e) n(t))) is the information that t gives about e, out of
IC(e) = log2(N / n(e)) in all. n(t) and n(e) count the documents that hold t and e at all, over the
whole corpus, and n(e,t) those where t is tied to e:

- a class, by its context: t is one of the WINDOW terms before or after an identifier of the class, in
  MIN_TOGETHER documents or more. So an address that occurs once is protected, too;
- an identifier, by its company: t stands anywhere in a document that holds it, in MIN_TOGETHER
  documents or more, as one document shows no tie;
- an identifier, by its parts: t is one of the words in it (of three letters or more) and stands
  outside of it in a document that holds it; one document is enough, as the spelling is the tie.

Below FIRM documents a count is little evidence and the first two are smoothed: DOUBT of a document more is
taken to hold t without e. A term that gives THRESHOLD of an entity's information is disclosing;
wherever it stands, it is a span of the kind "term", to be removed, and base spans are
generalised to their kind. All counts are aggregated by entity and term before they meet.

Disclosing terms are broadcast as 64-bit hashes while there are at most MAX_TERMS (16 MB); beyond
that, documents' terms are joined with them by shuffle. Both give the same spans.

Defined results: a null text is empty; a term that overlaps a base span stays part of that
span; repeated rows are counted and scanned one by one; an empty table gives an empty result;
other columns are kept by find(), but one named spans gives way to its own.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_batches

KINDS = ("email", "ip", "card", "phone", "term")
MIN_TOGETHER, WINDOW = 2, 5
FIRM, DOUBT = 5, 0.5
THRESHOLD = 0.9
MAX_TERMS = 2_000_000
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match can only start where a run of digits starts, and takes whole runs
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TERM = re.compile(r"[^\W_]+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ to both sides, so that long runs without one are read once."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            end = m.end()
            at = text.find("@", end)
        else:
            end = at + 1
            at = text.find("@", at + 1)


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def luhn(digits: str) -> bool:
    total = sum(int(c) for c in digits[-1::-2]) + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(c)] for c in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, position of the kind in KINDS, end), sorted."""
    out = [(a, 0, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(map(_byte, m[0].split("."))):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if 12 <= m.end() - m.start():
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def _hash(term: str) -> int:
    return xxhash.xxh3_64_intdigest(term.lower().encode("utf-8", "surrogatepass"))


def _terms(text: str, spans: list[tuple[int, int, int]]) -> list[re.Match]:
    """The terms that overlap no base span."""
    out, k, covered = [], 0, 0
    for m in _TERM.finditer(text):
        while k < len(spans) and spans[k][0] < m.end():
            covered, k = max(covered, spans[k][2]), k + 1
        if m.start() >= covered:
            out.append(m)
    return out


def entity(text: str, span: tuple[int, int, int]) -> int:
    """The hash of an identifier."""
    a, k, b = span
    return xxhash.xxh3_64_intdigest(f"{k}:{text[a:b].lower()}".encode("utf-8", "surrogatepass"))


def ties(text: str) -> tuple[set, set, set, set, set] | None:
    """Of a text with identifiers: identifiers, classes, terms outside, (class, term) in context,
    (identifier, term) by its parts; terms and identifiers as hashes."""
    if not (spans := base_spans(text)):
        return None
    terms = _terms(text, spans)
    hashes, starts = [_hash(m[0]) for m in terms], [m.start() for m in terms]
    outside, near, parts = set(hashes), set(), set()
    for span in spans:
        a, k, b = span
        before, after = bisect.bisect_left(starts, a), bisect.bisect_left(starts, b)
        near |= {(k, t) for t in hashes[max(0, before - WINDOW) : before] + hashes[after : after + WINDOW]}
        words = {_hash(m[0]) for m in _TERM.finditer(text[a:b]) if len(m[0]) > 2 and not m[0].isdigit()}
        parts |= {(entity(text, span), t) for t in words & outside}
    return {entity(text, s) for s in spans}, {s[1] for s in spans}, outside, near, parts


def fit(docs: DataFrame, min_together: int = MIN_TOGETHER, threshold: float = THRESHOLD) -> DataFrame:
    """term: the hashes of the disclosing terms, a written table."""
    text_batches(docs.sparkSession)
    texts = docs.select(F.col("text").cast("string").alias("text"))
    longs = lambda values: np.array(sorted(values), dtype=np.uint64).view(np.int64)

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text in pdf["text"]:
                if text and (tied := ties(text)):
                    es, kinds, outside, near, parts = tied
                    near, parts = sorted(near), sorted(parts)
                    out.append((longs(es), sorted(kinds), longs(outside), [k for k, _ in near], [t - (t >> 63 << 64) for _, t in near], [e - (e >> 63 << 64) for e, _ in parts], [t - (t >> 63 << 64) for _, t in parts]))
            yield pd.DataFrame(out, columns=["e", "kinds", "t", "nk", "nt", "pe", "pt"])

    # the documents that hold entities, numbered when they are written
    kinds = "e array<long>, kinds array<long>, t array<long>, nk array<long>, nt array<long>, pe array<long>, pt array<long>"
    own = materialize(texts.mapInPandas(found, kinds).withColumn("r", F.monotonically_increasing_id()))
    each = own.select("r", F.explode("e").alias("e"))
    n_e = materialize(each.groupBy("e").agg(F.count("*").alias("n_e")))
    shared = each.join(n_e.filter(F.col("n_e") >= min_together), "e").groupBy("r").agg(F.collect_list(F.struct("e", "n_e")).alias("es"))
    company = own.select("r", "t").join(shared, "r").select(F.explode("es").alias("x"), "t").select("x.e", "x.n_e", F.explode("t").alias("t"))
    company = company.groupBy("e", "n_e", "t").agg(F.count("*").alias("n_et")).filter(F.col("n_et") >= min_together)
    n_k = own.select(F.explode("kinds").alias("e")).groupBy("e").agg(F.count("*").alias("n_e"))
    pairs = lambda a, b: own.select(F.explode(F.arrays_zip(a, b)).alias("x")).groupBy(F.col(f"x.{a}").alias("e"), F.col(f"x.{b}").alias("t")).agg(F.count("*").alias("n_et"))
    context = pairs("nk", "nt").filter(F.col("n_et") >= min_together).join(n_k, "e")
    parts = pairs("pe", "pt").join(n_e, "e")
    doubt = F.when(F.col("n_et") < FIRM, F.lit(DOUBT)).otherwise(0.0)
    columns = ("n_e", "t", "n_et")
    both = materialize(company.union(context.select("e", *columns)).select(*columns, doubt.alias("doubt")).union(parts.select(*columns, F.lit(0.0))))

    def held(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            terms = [np.fromiter({_hash(w) for w in set(_TERM.findall(t or ""))}, dtype=np.uint64) for t in pdf["text"]]
            t, n = np.unique(np.concatenate([*terms, np.zeros(0, np.uint64)]), return_counts=True)
            yield pd.DataFrame({"t": t.view(np.int64), "n": n})

    n_docs = docs.count()
    frequency = texts.mapInPandas(held, "t long, n long").groupBy("t").agg(F.sum("n").alias("n_t"))
    rows = both.join(frequency, "t").withColumn("N", F.lit(n_docs))
    information = F.expr("log2(N * double(n_et) / (double(n_e) * (n_t + doubt)))")
    whole = F.expr("log2(N / double(n_e))")
    return materialize(rows.filter((whole > 0) & (information >= threshold * whole)).select(F.col("t").alias("term")).distinct())


def _spans(text: str, disclosing) -> str:
    spans = base_spans(text)
    if len(disclosing):
        spans = sorted(spans + [(m.start(), 4, m.end()) for m in _terms(text, spans) if _hash(m[0]) in disclosing])
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find(docs: DataFrame, terms: DataFrame, max_terms: int = MAX_TERMS) -> DataFrame:
    """docs with the added column spans: kind:start:end of all spans, in code points, end
    exclusive, by start, then kind, comma-joined."""
    text = F.col("text").cast("string")
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != "spans"])
    text_batches(docs.sparkSession)
    if terms.count() <= max_terms:
        held = docs.sparkSession.sparkContext.broadcast(terms.toArrow()["term"].to_numpy().view(np.uint64))

        def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            disclosing = set(held.value.tolist())
            for s in texts:
                yield s.map(lambda t: _spans(t or "", disclosing), na_action=None)

        return docs.withColumn("spans", F.pandas_udf(run, "string")(text))

    def hashes(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: np.fromiter({_hash(w) for w in set(_TERM.findall(t or ""))}, dtype=np.uint64).view(np.int64), na_action=None)

    def own(texts: pd.Series, held: pd.Series) -> pd.Series:
        return pd.Series([_spans(t or "", set() if h is None else set(np.asarray(h, dtype=np.int64).view(np.uint64).tolist())) for t, h in zip(texts, held, strict=True)], dtype=object)

    # by digest of the text, as ids may be null or repeated
    key = F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)
    held_by = docs.select(key.alias("__key"), F.explode(F.pandas_udf(hashes, "array<long>")(text)).alias("term")).distinct().join(terms, "term")
    held_by = held_by.groupBy("__key").agg(F.collect_list("term").alias("__held"))
    joined = docs.withColumn("__key", key).join(held_by, "__key", "left")
    return joined.withColumn("spans", F.pandas_udf(own, "string")(text, F.col("__held"))).select(*[F.col(f"`{c}`") for c in docs.columns], "spans")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, counts by kind, base_sha256 and spans of find()."""
    each = F.filter(F.split("spans", ","), lambda s: s != "")

    def count(kind: str):
        return F.size(F.filter(each, lambda s: s.startswith(f"{kind}:"))).cast("long").alias(f"n_{kind}")

    base = F.array_join(F.filter(each, lambda s: ~s.startswith("term:")), ",")
    return found.select("doc_id", *map(count, KINDS), F.sha2(base.cast("binary"), 256).alias("base_sha256"), "spans")


def sanitise(text: str, spans: str) -> str:
    """A text with base spans generalised to [KIND] and disclosing terms removed."""
    out, at = [], 0
    for kind, a, b in (x.split(":") for x in spans.split(",") if x):
        if int(a) < at:
            a = str(at)
        if int(b) <= at:
            continue
        out += [text[at : int(a)], "" if kind == "term" else f"[{kind.upper()}]"]
        at = int(b)
    return "".join([*out, text[at:]])
