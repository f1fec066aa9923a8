"""The corpus operators on small fixtures: odd rows, plain versions of each contract, and
properties of their parts."""

import hashlib
import random
import re
import zlib
from collections import Counter
from functools import reduce

import numpy as np
import pytest
import xxhash
from conftest import same
from pyspark.sql import functions as F

from graphloom.llm import fingerprints, licenses, line_dedup, mixing, near_dups, packing, pii, quality, queries, topk, toxicity
from graphloom.llm.common import SPACE
from graphloom.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, key string, score double, size long, id long, spans string, bands string"
WORDS = [f"w{i}" for i in range(400)]


def corpus(seed=0, n=60):
    rng = random.Random(seed)
    texts = [" ".join(rng.choices(WORDS, k=rng.randint(5, 60))) for _ in range(n)]
    for i in range(10):  # near copies and exact ones
        base = texts[i].split()
        base[rng.randrange(len(base))] = "changed"
        texts += [" ".join(base), texts[i]]
    line = "This Line is long enough to be counted as a repeated one "
    texts += [f"{t}\n{line if i % 2 else line.upper()}\nshort" for i, t in enumerate(texts[:7])]
    return texts


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 1, "k", 0.5, 2, 3, "x", "y") for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(3 * i, t, f"s{i % 4}" if i % 5 else None) for i, t in enumerate(corpus())]
    rows += [(1, None, "s0"), (2, "", "s1"), (4, " \n\t ", "s1"), (7, "one", "s2"), (10, " ".join(WORDS) * 60, "s3"), (None, "a row without an id", "s0")]
    return frame(spark, [*rows, rows[0]]).cache()


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(docs):
    return [(r["doc_id"], r["text"] or "", r["source"]) for r in docs.collect()]


def test_fingerprints(spark, docs):
    got = fingerprints.compare_edits(docs).collect()
    rows = sorted(((i, t) for i, t, _ in rows_of(docs)), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    expected = Counter()
    for k, (i, t) in enumerate(rows):
        after, half = rows[(k + 1) % len(rows)][1], len(t) // 2
        expected[i, len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == expected
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    by_text = {}
    for r in got:
        text = next(t for i, t in rows if i == r["doc_id"])
        by_text.setdefault(text, set()).add(r["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values())
    assert sum(r["near_edited"] for r in got) > sum(r["near_next"] for r in got)
    assert fingerprints.compare_edits(empty(spark)).count() == 0
    one = fingerprints.compare_edits(frame(spark, [(5, "just one row of text", None)])).collect()
    assert one[0]["edited_sha256"] == hashlib.sha256(b"just one rjust one r").hexdigest()


def plain_imatch(texts):
    """Fingerprints of texts (a list of one a row) and likeness, as the docstring defines them."""
    fold = lambda hs, seed=42: reduce(lambda h, x: xxhash.xxh64_intdigest(x.to_bytes(8, "little"), h), hs, seed)
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    words = [[xxhash.xxh64_intdigest(w.encode(), 42) for w in re.findall(r"[^\x20\x09-\x0D]+", t.lower())] for t in texts]
    keys = []
    for w in words:
        g = [signed(fold(w[i : i + 3])) for i in range(len(w))]
        keys.append([min((x for x in g if x % fingerprints.KEYS == j), default=None) for j in range(fingerprints.KEYS)])
    often = {k: n for k, n in Counter(k for ks in keys for k in ks if k is not None).items() if n >= 2 and n >= fingerprints.LOW * len(texts)}
    classes = []
    for i, ks in enumerate(keys):
        held = [(often[k], k) for k in ks if k in often]
        classes.append(max(held)[1] if len(held) >= fingerprints.SHARED else ("own", i))
    n, by = Counter(t for w in words for t in set(w)), {}
    for w, c in zip(words, classes, strict=True):
        for t in set(w):
            by.setdefault(t, set()).add(c)
    lex = {t for t in n if n[t] >= 2 and n[t] >= fingerprints.LOW * len(texts) and len(by[t]) <= fingerprints.HIGH * len(set(classes))}

    def of(w):
        own = {signed(t) for t in set(w) & lex}
        if len(own) < fingerprints.FEW:
            others = sorted((signed(xxhash.xxh64_intdigest((0xFFFFFFFF).to_bytes(4, "little"), fold([t % (1 << 64)]))), t) for t in {signed(t) for t in w} - own)
            own |= {t for _, t in others[: fingerprints.FEW - len(own)]}
        out, bit = [], 0
        show = lambda s: f"{fold([t % (1 << 64) for t in sorted(s)]):016x}"[8:] if s else fingerprints.EMPTY
        for _ in range(fingerprints.OUTER):
            outer = {t for t in own if t >> bit & 3 == 0}
            out.append(show(outer))
            bit += 2
            for _ in range(fingerprints.INNER):
                s = outer
                for _ in fingerprints.RATES:
                    s = {t for t in s if t >> bit & 3 == 0}
                    out.append(show(s))
                    bit += 2
        return "".join(out)

    return [of(w) for w in words]


def plain_likeness(a, b):
    pairs = [(a[i : i + 8], b[i : i + 8]) for i in range(0, len(a), 8)]
    either = [p for p in pairs if p != (fingerprints.EMPTY,) * 2]
    return 1.0 if a == b else sum(x == y for x, y in either) / len(either) if either else 1.0


def test_fingerprints_match_the_plain_version(spark):
    rng = random.Random(12)
    texts = [" ".join(rng.choices(WORDS, [1 / (i + 1) for i in range(len(WORDS))], k=rng.choice([0, 1, 5, 60, 300]))) for _ in range(150)]
    texts += [t.replace("w3 ", "changed ", 1) for t in texts[:60]] + [texts[3]] * 40
    got = {r["doc_id"]: r for r in fingerprints.compare_edits(frame(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    plain = plain_imatch(texts)
    assert [got[i]["fingerprint"] for i in range(len(texts))] == plain
    assert len(set(plain)) > 100
    for i in range(len(texts)):
        r = got[i]
        assert abs(r["near_next"] - plain_likeness(plain[i], plain[(i + 1) % len(texts)])) < 1e-12
        assert abs(r["near_edited"] - plain_likeness(plain[i], r["edited_fingerprint"])) < 1e-12


@pytest.mark.parametrize("kind", ["long", "string"])
def test_fingerprints_with_any_ids(spark, kind):
    """Ids beyond 2^53, and strings, are in the order of their own values; none lacks a next row."""
    rng = random.Random(13)
    ids = [rng.randrange(2**62, 2**63 - 1) if kind == "long" else f"{rng.randrange(10**6)}-é{i}" for i in range(300)] + [None]
    texts = {i: f"text of {i} " * 3 for i in ids}
    rows = spark.createDataFrame([(i, texts[i]) for i in ids], f"doc_id {kind}, text string")
    got = {r["doc_id"]: r["edited_sha256"] for r in fingerprints.compare_edits(rows).collect()}
    order = sorted(ids, key=lambda i: (i is not None, (i.encode() if kind == "string" else i) if i is not None else 0))
    for k, i in enumerate(order):
        t, after = texts[i], texts[order[(k + 1) % len(order)]]
        half = len(t) // 2
        assert got[i] == hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()


def test_fingerprints_of_a_group_of_a_third_of_all_rows(spark):
    """Near copies stay alike however many there are, and their words stay in the lexicon."""
    rng = random.Random(8)
    own = [f"v{i}" for i in range(6000)]
    base = rng.choices(own, k=215)
    rows = [(3 * i, " ".join(["the", "of", *rng.choices(own, k=80)]), "s") for i in range(400)]
    for i in range(200):
        text = list(base)
        for _ in range(2):
            text[rng.randrange(len(text))] = rng.choice(own)
        rows.append((10000 + i, " ".join(text), "s"))
    docs = frame(spark, rows)
    held = {r["term"] for r in fingerprints.lexicon(docs).collect()}
    hashes = dict(spark.createDataFrame([(w,) for w in [*sorted(set(base)), "the", "of"]], "w string").select("w", F.xxhash64("w")).collect())
    assert hashes["the"] not in held and hashes["of"] not in held
    assert sum(hashes[w] in held for w in set(base)) > 0.95 * len(set(base))
    near = [r["near_next"] for r in fingerprints.compare_edits(docs).collect() if 10000 <= r["doc_id"] < 10199]
    assert len(near) == 199 and sum(near) / len(near) > 0.5


def test_fingerprints_with_few_lexicon_terms(spark):
    """One lexicon term more or less does not change what else is hashed."""
    words = [f"c{i}" for i in range(200)]
    rows = [(i, " ".join([*words, *own]), "s") for i, own in enumerate([["rare"], []] * 20)]
    rare = spark.createDataFrame([("rare",)], "w string").select(F.xxhash64("w").alias("term"))
    got = fingerprints.fingerprint(frame(spark, rows[:2]), "text", fingerprints.bloom(rare, 12), "f", 12).select("f").collect()
    assert spark.range(1).select(fingerprints.likeness(*[f"'{r['f']}'" for r in got])).first()[0] > 0.2


def plain_components(rows, width):
    sets = {}
    for k, (i, t, _) in enumerate(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
        sets[k] = {tuple(w[j : j + width]) for j in range(max(1, len(w) - width + 1))} if w else set()
    near = {k: {k} for k in sets}
    ids = [r[0] for r in rows]
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            linked = sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both)
            if a < b and None not in (ids[a], ids[b]) and (linked or ids[a] == ids[b]):
                near[a].add(b), near[b].add(a)
    out = []
    for k in sets:
        seen, todo = {k}, [k]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out.append((ids[k], len(sets[k]), min((ids[j] for j in seen), key=lambda x: (x is None, x or 0))))
    return Counter(out)


@pytest.mark.parametrize("width", [2, 5])
def test_near_dups(spark, docs, width):
    got = near_dups.components(docs, width=width).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == plain_components(rows_of(docs), width)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"] or r["doc_id"] is None) for r in got)
    assert near_dups.components(empty(spark), width=width).count() == 0


def test_near_dups_of_a_loose_group(spark):
    """Copies of a text whose differences from each other lie around the limit."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(90):
        own = list(base)
        for _ in range(rng.randint(2, 9)):
            own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}" if rng.random() < 0.7 else f"y{rng.randrange(4)}"
        rows.append((i, " ".join(own), "s"))
    got = near_dups.components(frame(spark, rows), width=2).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == plain_components(rows, 2)


def test_near_dups_of_a_group_whose_hub_was_edited(spark, monkeypatch):
    """A shared passage with one edit in each document, and own words that keep most apart: the
    hub's edit is in all differences from it. Some have a twin, which is no hub."""
    rng = random.Random(7)
    rows = []
    for i in range(150):
        passage = [f"b{j}" for j in range(100)]
        passage[rng.randrange(100)] = f"e{i}"
        text = passage + [f"o{i}x{j}" for j in range(rng.choice([8, 14, 25]))]
        rows.append((len(rows), " ".join(text), "s"))
        if i % 10 == 0:
            text[rng.randrange(100)] = "twin"
            rows.append((len(rows), " ".join(text), "s"))
    frequent, plain = [], near_dups.compare
    monkeypatch.setattr(near_dups, "compare", lambda pairs, *more: frequent.append(pairs.filter("size(often) > 0").count()) or plain(pairs, *more))
    for width in (2, 5):
        got = near_dups.components(frame(spark, rows), width=width).collect()
        assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == plain_components(rows, width)
    assert sum(frequent) > 0
    with pytest.raises(ValueError, match="64"):
        near_dups.components(frame(spark, rows[:2]), rows=2, n_bands=65)


def test_sketch_agrees_as_jaccard():
    rng = np.random.default_rng(1)
    common, a, b = (rng.integers(0, 2**63, k).astype(np.uint64) for k in (60, 20, 20))
    s = near_dups.sketch([np.concatenate([common, a]), np.concatenate([common, b]), common[:1]], 2000)
    assert (s != near_dups._EMPTY).all()  # every coordinate is filled, even from one shingle
    assert abs((s[0] == s[1]).mean() - 0.6) < 0.05


def test_components_of_long_paths(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a long, b long")
    got = dict(connected_components(links).collect())
    assert {got[i] for i in range(201)} == {0} and got[501] == 500
    assert connected_components(links.limit(0)).count() == 0


def test_toxicity(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        words = rng.choices(WORDS, k=40)
        toxic = int(i % 4 == 0)
        if toxic:
            words[5:8] = ["vile", "scummy", "awful"]
        rows.append((i, " ".join(words), "s"))
        labels.append((i, toxic))
    docs = frame(spark, [*rows, (1000, None, "s"), (None, "", None), rows[0]])
    held = spark.createDataFrame([*labels, (5000, 1), (None, 1), (6000, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, held.filter(~toxicity.held_out()))
    assert len(model.index) < 2000
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    out = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i] >= 0.5) == (i % 4 == 0) for i in out) >= 0.95 * len(out)
    assert all(0 <= s <= 1 for s in got.values()) and 1000 in got
    for few in (held.filter("toxic = 0"), held.filter("toxic = 1"), held.limit(0)):
        constant = toxicity.score(docs, toxicity.fit(docs, few)).select("score").distinct().collect()
        assert len(constant) == 1
    assert toxicity.score(empty(spark), model).count() == 0


def test_ftrl_matches_the_plain_algorithm():
    """Per-coordinate FTRL-proximal, one coordinate at a time."""
    import math

    rng = random.Random(15)
    rows = [sorted(rng.sample(range(60), rng.randint(0, 12))) for _ in range(200)]
    labels = [int(bool({3, 17, 40} & set(r)) and rng.random() < 0.95) for r in rows]
    alpha, beta, l1, l2, times = 3.0, 1.0, 8.0, 1.0, 2.0
    often = {i for i, n in Counter(i for r in rows for i in r).items() if n >= toxicity.MIN_ROWS}
    z, n, bias = Counter(), Counter(), -1

    def weight(i):
        cost = 0.0 if i == bias else l1
        return 0.0 if abs(z[i]) <= cost else -(z[i] - math.copysign(cost, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(toxicity.EPOCHS):
        for r, y in zip(rows, labels, strict=True):
            own = {i: weight(i) for i in [*(i for i in r if i in often), bias]}
            g = (1 / (1 + math.exp(-sum(own.values()))) - y) * (times if y else 1.0)
            for i, w in own.items():
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w
                n[i] += g * g
    flat, ends = np.array([i for r in rows for i in r], dtype=np.int32), np.cumsum([len(r) for r in rows])
    model = toxicity.ftrl(flat, ends, np.array(labels))
    plain = {i: weight(i) for i in often if weight(i)}
    assert set(model.index.tolist()) == set(plain) and 3 <= len(plain) < 40
    assert all(abs(w - plain[i]) < 1e-5 for i, w in zip(model.index.tolist(), model.weight, strict=True)) and abs(model.bias - weight(bias)) < 1e-9


def test_licenses(spark, docs):
    """Every template, on lines of its own, wrapped, with words around and changed."""
    rng = random.Random(9)
    every = [(name, t) for name, ts in licenses.TEMPLATES.items() for t in ts]
    rows, expected = [], {}
    for k, (name, t) in enumerate(every):
        w = t.split()
        wrapped = "\n".join(" ".join(w[i : i + 7]) for i in range(0, len(w), 7))
        changed = list(w)
        for i in range(len(w) // 25):
            changed[rng.randrange(len(w))] = f"x{i}"
        for j, x in enumerate((f"Some text.\n{t}\nMore of it.", f"/* Copyright 2020 Jane Doe. {wrapped} */", t.upper(), f"so it says: {' '.join(changed)} and on")):
            rows.append((10000 + 10 * k + j, x, None))
            expected[10000 + 10 * k + j] = name
    rows += [(20000, " ".join([licenses.TEMPLATES["MIT"][1]] * 40), None), (20001, "of the software and the license is provided with the", None)]
    table = frame(spark, rows).union(docs)
    got = licenses.scan(table).toPandas()
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.register("documents", table.toPandas())
    same(got, con.execute(licenses.oracle()).df())
    found = got.set_index("doc_id")["license"]
    kin = {"AGPL-3.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0"}, {"BSD-2-Clause", "BSD-3-Clause"}, {"CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0"}
    near = lambda a, b: a == b or any(a in k and b in k for k in kin)
    assert all(near(found[i], name) for i, name in expected.items())
    assert all(found[i] == name for i, name in expected.items() if i % 10 in (0, 1, 2))
    assert found[20000] == "MIT" and found[20001] is None
    assert licenses.scan(empty(spark)).count() == 0
    assert licenses.scan(docs, {}).filter("license is null and dice = 0").count() == docs.count()
    plan = licenses.scan(table)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan.split("Subquery")[0]


PII = "Mail x.y+z@mail.example.com, not a@b or @c.de; ip 192.168.0.255 and 256.1.1.1 or 1.2.3.4.5; card 4111 1111 1111 1111, not 4111-1111-1111-1112; call +1 (988) 555-2485 or +12."


def plain_spans(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 12 <= len(d) <= 19 and (sum(d[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_base_spans():
    assert len(pii.base_spans(PII)) == 5
    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choices("aZ9.@-+ ()12é3\n%", k=rng.randint(0, 60)))
        assert pii.base_spans(text) == plain_spans(text), text
    assert pii.base_spans("a" * 200_000 + "1" * 200_000) == []


def test_pii(spark, docs):
    secret = [(1000 + i, f"zanzibar writes to boss@corp.example.org {w} and more", None) for i, w in enumerate(WORDS[:8])]
    every = docs.union(frame(spark, [*secret, (2000, "alone zanzibar speaks", None), (2001, PII, None)]))
    terms = pii.fit(every)
    a = pii.find(every, terms)
    b = pii.find(every, terms, max_terms=0)
    pairs = [Counter((r["doc_id"], r["text"], r["spans"]) for r in x.collect()) for x in (a, b)]
    assert pairs[0] == pairs[1]
    spans = {r["doc_id"]: r["spans"] for r in a.collect()}
    # Mail is a word of the address itself
    assert spans[2001].startswith("term:0:4,email:5:27,ip:")
    assert "term:0:8" in spans[1000]  # the name beside the address gives it away
    assert spans[1] == "" and spans[2] == ""
    got = {r["doc_id"]: r for r in pii.digest(a).collect()}
    base = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in plain_spans(PII))
    assert got[2001]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
    assert (got[2001]["n_email"], got[2001]["n_ip"], got[2001]["n_card"], got[2001]["n_phone"]) == (1, 2, 1, 1)
    assert "boss@" not in pii.sanitise(secret[0][1], spans[1000]) and "zanzibar" not in pii.sanitise(secret[0][1], spans[1000])
    assert pii.digest(pii.find(empty(spark), pii.fit(empty(spark)))).count() == 0


def test_pii_of_few_documents(spark, docs):
    """A name that stands only with one address, far from it, in two and in four documents."""
    gap = " ".join(WORDS[:30])
    rows = [(3000 + i, f"quagga signs {gap} {w} rare@corp.example.org", None) for i, w in enumerate(WORDS[300:304])]
    rows += [(3100 + i, f"okapi writes at length {gap} {w} 10.1.2.3", None) for i, w in enumerate(WORDS[310:312])]
    rows += [(3200, "once tapir and only@corp.example.org", None)]
    every = docs.union(frame(spark, rows))
    spans = {r["doc_id"]: r["spans"].split(",") for r in pii.find(every, pii.fit(every)).collect()}
    assert all("term:0:6" in spans[3000 + i] for i in range(4)) and all("term:0:5" in spans[3100 + i] for i in range(2))
    assert not any(s.startswith("term:5:10") for s in spans[3200])  # one document shows no tie
    assert not any(s.startswith("term:13:") for s in spans[3000])  # a word of many other documents


def test_pii_terms_match_plain_pmi(spark):
    """Disclosing terms by the formula, over single addresses with a tell-tale context, names that stand in
    addresses, and addresses of several documents."""
    import math

    rng = random.Random(11)
    texts = [" ".join(rng.choices(WORDS, [1 / (i + 1) for i in range(len(WORDS))], k=40)) for _ in range(300)]
    for i in range(0, 60):
        words = texts[i].split()
        kind = i % 3
        words[20:20] = [("writeme" if i % 4 else "w1") + f" p{i}.q@h{i}.example.org", f"dial +1 (988) 555-{1000 + i}", f"host 10.0.{i}.7 port"][kind].split(" ")
        texts[i] = " ".join(words)
    texts += [f"mozart wrote w{i} to w3 {'mozart' if i % 2 else 'liszt'}.w2@wien.example.org w5" for i in range(2)]
    texts += [f"verdi {w} same@corp.example.org" for w in ("w1", "w2", "w9")] + [f"rossini {w}" for w in WORDS[:4]]
    N, n_t, n_e, tied = len(texts), Counter(), Counter(), Counter()
    for t in texts:
        n_t.update({x.lower() for x in re.findall(r"[^\W_]+", t)})
        spans = plain_spans(t)
        outside = [(m.start(), m[0].lower()) for m in re.finditer(r"[^\W_]+", t) if not any(a < m.end() and m.start() < b for a, _, b in spans)]
        pairs, es = set(), set()
        for a, k, b in spans:
            es |= {("class", k), (k, t[a:b].lower())}
            pairs |= {("context", ("class", k), x) for x in [x for s, x in outside if s < a][-5:] + [x for s, x in outside if s >= b][:5]}
            pairs |= {("company", (k, t[a:b].lower()), x) for _, x in outside}
            pairs |= {("parts", (k, t[a:b].lower()), x) for _, x in outside if x in re.findall(r"[^\W_]+", t[a:b].lower()) and len(x) > 2 and not x.isdigit()}
        n_e.update(es)
        tied.update(pairs)
    expected = set()
    for (how, e, t), n in tied.items():
        if n >= (1 if how == "parts" else 2) and n_e[e] < N:
            doubt = 0.5 if n < 5 and how != "parts" else 0
            if math.log2(N * n / (n_e[e] * (n_t[t] + doubt))) >= 0.9 * math.log2(N / n_e[e]):
                expected.add(t)
    docs = frame(spark, [(i, t, None) for i, t in enumerate(texts)])
    got = {r["term"] % (1 << 64) for r in pii.fit(docs).collect()}
    assert got == {pii._hash(t) for t in expected}
    assert {"writeme", "dial", "host", "port", "mozart", "verdi"} <= expected and not {"rossini", "w1", "liszt"} & expected


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    special = frame(spark, [(5000, "a<|endoftext|>b", None)])
    got = packing.pack(docs.union(special)).toPandas()
    t = Tokenizer.from_file(packing.default_paths()[0])
    expected = Counter()
    for i, text, _ in rows_of(docs.union(special)):
        ids = [*t.encode(text, add_special_tokens=False).ids, 0]
        for k, (s, n) in enumerate(packing.cut(len(ids), packing.CAPACITY)):
            expected[i, k, s, n, zlib.crc32(np.array(ids[s : s + n], dtype="<u4").tobytes())] += 1
    assert Counter((None if np.isnan(r[0]) else int(r[0]), *map(int, r[1:])) for r in got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)) == expected
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        assert own["length"].sum() <= packing.CAPACITY
        assert (own["offset"].to_numpy() == own["length"].cumsum().to_numpy() - own["length"].to_numpy()).all()
    assert packing.pack(empty(spark)).count() == 0


def test_packing_plans():
    rng = random.Random(4)
    for n in (0, 1, 7, 5000):
        counts = Counter(min(2048, max(1, int(rng.lognormvariate(6, 1)))) for _ in range(n))
        for groups in (1, 16, 2048):
            plan, held = packing.plan_bins(counts, 2048, groups), Counter()
            for sizes, k in plan:
                assert sum(sizes) <= 2048 and k > 0
                for s in sizes:
                    held[s] += k
            assert held == counts
        least = -(-sum(k * c for k, c in counts.items()) // 2048)
        assert sum(k for _, k in packing.best_plan(counts)) <= least * 1.02 + 1
    assert packing.cut(2049, 2048) == [(0, 1), (1, 2048)] and packing.cut(4096, 2048) == [(0, 2048), (2048, 2048)]


def plain_topk(rows, asked, k):
    """Over (id, whole-number vector)."""
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = Counter()
    for q, v in {(q, tuple(v)) for q, v in rows if asked(q)}:
        best = sorted(((-dot(v, w), i) for i, w in rows if i != q))[:k]
        for r, (s, i) in enumerate(best):
            out[q, r + 1, i, -s] += 1
    return out


@pytest.mark.parametrize("bits", [topk.BITS, 2])
def test_topk(spark, bits, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 50)
    monkeypatch.setattr(topk, "QUERIES", 4)
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(200)]  # a vector of many rows
    rows += [(400, None), (401, [1.0, None]), (420, [float("nan")] * 6), (440, rows[0][1]), (None, [1.0] * 6), (460, [0.5, 0.5]), (3, rows[3][1]), (20, [9.0] * 6)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    v = topk.scaled(table, "vec_id", "embedding", 64)
    got = topk.search(v.filter("id % 20 = 0"), v, 5, bits).collect()
    ok = [(i, np.floor(64 * np.array(x)).astype(int).tolist()) for i, x in rows if i is not None and x and None not in x and not np.isnan(x).any()]
    # an id of two vectors asks with both, and has the best of either
    plain, one = plain_topk([r for r in ok if r[0] != 20], lambda i: i % 20 == 0, 5), [tuple(r) for r in got if r["query_id"] != 20]
    assert {r[0] for r in plain} == {r[0] for r in one}
    others = plain_topk(ok, lambda i: i % 20 == 0 and i != 20, 5)
    assert Counter(one) == others
    assert topk.search(v.limit(0), v, 5).count() == 0 and topk.search(v.limit(0), v.limit(0), 5).count() == 0
    named = v.select(F.concat(F.lit("k"), "id").alias("id"), "v")
    got = topk.search(named.filter("id like '%0'"), named.filter("id <> 'k20'"), 3, bits).collect()
    assert Counter(map(tuple, got)) == plain_topk([(f"k{i}", x) for i, x in ok if i != 20], lambda i: i.endswith("0"), 3) + Counter(tuple(r) for r in got if r["query_id"] == "k20")


def test_topk_of_large_components(spark):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.random.default_rng(2).integers(-(2**29), 2**29, (40, 4)))]
    v = topk.scaled(spark.createDataFrame(rows, "id long, e array<double>"), "id", "e", 1)
    assert Counter(map(tuple, topk.search(v, v, 3).collect())) == plain_topk([(i, [int(x) for x in e]) for i, e in rows], lambda i: True, 3)
    wide = topk.scaled(spark.createDataFrame([(1, [1e17, 1.0]), (2, [1e17, 2.0])], "id long, e array<double>"), "id", "e", 64)
    with pytest.raises(ValueError, match="long"):
        topk.search(wide, wide, 1)


def test_bounds_hold():
    rng = np.random.default_rng(1)
    x, q = rng.integers(-640, 640, (500, 16)), rng.integers(-64, 64, (9, 16))
    for bits in (2, 6):
        grid = topk.Grid(x.min(axis=0), x.max(axis=0), bits)
        low, high = grid.bounds(grid.cells(x), q)
        assert (low <= q @ x.T).all() and (q @ x.T <= high).all() and grid.cells(x).max() < 1 << bits


def plain_lines(rows):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(SPACE))
    held = {}
    for i, t, _ in rows:
        for x in t.split("\n"):
            if i is not None and len(key(x)) >= 40:
                held.setdefault(key(x), set()).add(i)
    gone = {k: max(v) for k, v in held.items() if len(v) >= 5}
    out = Counter()
    for i, t, _ in rows:
        lines = t.split("\n")
        kept = [x for x in lines if i is None or key(x) not in gone or gone[key(x)] == i]
        out[i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("most", [line_dedup.MAX_FILTER_BYTES, 0])
def test_line_dedup(spark, docs, most):
    index = line_dedup.LineIndex.of(docs, max_filter_bytes=most)
    clash = docs.withColumn("n_dropped", F.lit("x")).withColumn("N_lines", F.lit("y")).withColumn("keys", F.lit("z"))
    got = line_dedup.dedup(clash, index)
    assert got.columns == [*docs.columns, "keys", "n_lines", "n_dropped"]
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in got.collect()) == plain_lines(rows_of(docs))
    assert line_dedup.dedup(empty(spark), line_dedup.LineIndex.of(empty(spark))).count() == 0


def test_line_dedup_can_be_taken_back(spark):
    """Insertions and deletions lead to the decisions and filters of an index made at once."""
    line = "a line that is certainly longer than forty characters"
    rows = [(i, f"{line}\nown line {i} that is longer than forty characters, too" + ("\n" + line.replace("line", "row") if i % 2 else ""), None) for i in range(14)]

    def state(index):
        held = {r["shard"]: line_dedup.CuckooFilter.from_bytes(bytes(r["data"])) for r in index.filters.collect()}
        counts = {(r["h1"], r["h2"]): (r["n"], r["keeper"]) for r in index.counts.collect()}
        assert all(held[h1 % line_dedup.SHARDS].contains(np.array([h2], dtype=np.int64).view(np.uint64))[0] for h1, h2 in counts)
        texts = Counter((r["doc_id"], r["text"], r["n_dropped"]) for r in line_dedup.dedup(frame(spark, rows).select("doc_id", "text"), index).collect())
        return counts, {s: int((f.table > 0).sum()) for s, f in held.items() if f.table.any()}, texts

    four = line_dedup.LineIndex.of(frame(spark, rows[:4]))
    assert four.counts.count() == 0
    five = four.insert(frame(spark, rows[4:5]))
    assert [(r["n"], r["keeper"]) for r in five.counts.collect()] == [(5, 4)]
    every = five.insert(frame(spark, rows[3:]))
    whole = line_dedup.LineIndex.of(frame(spark, rows))
    assert state(every) == state(whole) and every.counts.count() == 2
    fewer = every.delete(frame(spark, [rows[13], rows[2]]))
    assert state(fewer) == state(line_dedup.LineIndex.of(frame(spark, rows[:2] + rows[3:13])))
    less = every.delete(frame(spark, rows[4:]))
    assert state(less) == state(four) and less.postings.exceptAll(four.postings).count() == 0
    exact = line_dedup.LineIndex.of(frame(spark, rows[:4]), max_filter_bytes=0).insert(frame(spark, rows[4:]))
    assert exact.filters is None and exact.counts.exceptAll(whole.counts).count() == 0


def test_cuckoo_filters():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 2**63, 5000).astype(np.uint64)
    f = line_dedup.CuckooFilter.of(keys)
    assert f.contains(keys).all()
    other = rng.integers(0, 2**63, 20000).astype(np.uint64)
    assert f.contains(other).mean() < 0.01
    for k in keys[:2500]:
        assert f.delete(int(k))
    assert f.contains(keys[2500:]).all() and f.contains(keys[:2500]).mean() < 0.01
    assert line_dedup.CuckooFilter.from_bytes(f.to_bytes()).contains(keys[2500:]).all()


def test_quality(spark):
    rng = random.Random(6)
    good = [(i, " ".join(rng.choices(["the cat", "sat on", "a warm mat", "and slept"], k=20)), "s") for i in range(80)]
    bad = [(100 + i, "".join(chr(rng.randrange(33, 126)) for _ in range(200)), "s") for i in range(10)]
    docs = frame(spark, [*good, *bad, (300, None, "s"), (301, "", None), good[0]])
    labels = spark.createDataFrame([(i, 1) for i, _, _ in good] + [(100, 0), (None, 1)], "doc_id long, quality int")
    trusted = quality.trusted(docs, labels)
    got = {r["doc_id"]: r for r in quality.classify(docs, trusted).collect()}
    assert sum(got[i]["kept"] for i, _, _ in good) >= 78 and not any(got[i]["kept"] for i, _, _ in bad)
    table = quality.train(trusted)
    a, b = (dict(quality.score(docs.filter("doc_id is not null"), table, m).select("doc_id", "perplexity").collect()) for m in (10**9, 0))
    assert all(abs(a[i] - b[i]) < 1e-9 * b[i] for i in b) and set(a) == set(b)
    p = table.filter("kind = 'p'").withColumn("ctx", F.expr("substring(g, 1, length(g) - 1)")).withColumn("n", F.length("g"))
    assert p.filter("n = 5").groupBy("ctx").agg(F.sum(F.exp("value")).alias("s")).filter("s > 1.000001").count() == 0
    assert quality.classify(docs, quality.trusted(docs, labels.limit(0))).filter("kept").count() == docs.count()


def plain_kneser_ney(texts, order):
    """log P(letter | the order - 1 before it), by recursion over counted n-grams."""
    import math

    c = {order: Counter(g for t in texts for g in quality._grams(t, order))}
    for n in range(order - 1, 0, -1):
        c[n] = Counter(g[1:] for g in c[n + 1])
    d = {}
    for n in c:
        few = Counter(c[n].values())
        y = few[1] / (few[1] + 2 * few[2]) if few[1] else 0
        d[n] = [min(max(i - (i + 1) * y * few[i + 1] / few[i], 0.05), i) for i in (1, 2, 3)] if all(few[i] for i in (1, 2, 3, 4)) else [0.5, 0.75, 0.9]
    ctx = {n: {} for n in c}
    for n in c:
        for g, k in c[n].items():
            ctx[n].setdefault(g[:-1], []).append(k)

    def p(g):
        n = len(g)
        if n == 0:
            return 1 / (len(c[1]) + 1)
        if g[:-1] not in ctx[n]:
            return p(g[1:])
        held = ctx[n][g[:-1]]
        cut = lambda k: d[n][min(k, 3) - 1]
        k = c[n].get(g, 0)
        return (max(k - cut(k), 0) / sum(held) if k else 0) + sum(map(cut, held)) / sum(held) * p(g[1:])

    return lambda t: math.exp(-sum(math.log(p(g)) for g in quality._grams(t, order)) / len(t))


def test_quality_matches_plain_kneser_ney(spark):
    rng = random.Random(14)
    parts = ["the cat", "sat on", "A warm mat", "and slept", "été", "so"]
    texts = [" ".join(rng.choices(parts, [5, 4, 3, 2, 1, 1], k=rng.randint(1, 30))) for _ in range(60)]
    table = quality.train(frame(spark, [(i, t, "s") for i, t in enumerate(texts)]))
    asked = [*texts[:20], "the dog sat", "ZZZ!", "a", "mat mat mat mat"]
    plain = plain_kneser_ney(texts, quality.ORDER)
    for most in (10**9, 0):
        got = {r["doc_id"]: r["perplexity"] for r in quality.score(frame(spark, [(i, t, "s") for i, t in enumerate(asked)]), table, most).collect()}
        assert all(abs(got[i] - plain(t)) < 1e-9 * got[i] for i, t in enumerate(asked))


def test_mixing(spark, docs):
    took = mixing.allot(docs).collect()
    sizes, per = Counter(), Counter()
    for r in took:
        assert r["copies"] in (0, 1, 2)
        per[r["source"]] += r["copies"] * r["size"]
        sizes[r["source"]] = r["source_size"]
    largest = max(r["size"] for r in took)
    goals = {r["source"]: r["target"] for r in took}
    assert abs(sum(goals.values()) - 1.5 * sum(sizes.values())) < 1e-6 * sum(sizes.values())
    assert all(goals[s] <= 2 * sizes[s] + 1e-9 and abs(per[s] - goals[s]) <= largest + 1 for s in goals)
    total = sum(sizes.values()) * 3 // 2
    assert total - largest < sum(per.values()) <= total
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in took)
    assert sorted(took) == sorted(mixing.allot(docs.repartition(5)).collect()) if None not in {r["doc_id"] for r in took} else True
    assert mixing.allot(empty(spark)).count() == 0 and mixing.mix(empty(spark)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, sf_dir, duck, name):
    same(queries.QUERIES[name](spark, sf_dir).toPandas(), duck.execute(queries.ORACLES[name]).df())
