"""SQL for the registered queries, written from their definitions."""

from __future__ import annotations

import math

from ..functions.scalar import PRIME, SLOPES
from ..operators.mlp import Network

_GA = "ga AS (SELECT 's' || l_suppkey AS src, 'p' || l_partkey AS dst, sum(l_quantity) AS w FROM lineitem GROUP BY 1, 2)"
_GB = "gb AS (SELECT 'c' || o_custkey AS src, 's' || l_suppkey AS dst, sum(l_quantity) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"
_BOTH = "adj AS (SELECT src, dst, w FROM {g} UNION ALL SELECT dst, src, w FROM {g})"
_ADJ = f"{_GA}, {_BOTH.format(g='ga')}"
_VX = "vx AS (SELECT name, row_number() OVER (ORDER BY length(name), name) - 1 AS id FROM (SELECT src AS name FROM ga UNION SELECT dst FROM ga))"
_IDS = f"{_GA}, {_VX}, e AS (SELECT a.id AS src, b.id AS dst, w FROM ga JOIN vx a ON a.name = src JOIN vx b ON b.name = dst)"
_IADJ = f"{_IDS}, adj AS (SELECT src, dst, w FROM e UNION ALL SELECT dst, src, w FROM e)"
_DADJ = f"{_IDS}, adj AS (SELECT src, dst, w FROM e)"


def _tally(k: int, where: str = "") -> str:
    return f"SELECT src, cluster, sum(w) AS w FROM adj JOIN l{k} ON v = dst {where} GROUP BY src, cluster"


def _best(k: int, where: str = "") -> str:
    """Heaviest label, then the current one, then the lowest."""
    return f"SELECT src, cluster FROM (SELECT t.src, t.cluster, row_number() OVER (PARTITION BY t.src ORDER BY round(t.w, 9) DESC, (t.cluster = now.cluster) DESC, t.cluster) AS r FROM ({_tally(k, where)}) t JOIN l{k} now ON now.v = t.src) WHERE r = 1"


def _rounds(n: int, halves: bool = True) -> str:
    out = ["l0 AS (SELECT id AS v, id AS cluster FROM vx)"]
    for k in range(n):
        where = f"WHERE src % 2 = {k % 2}" if halves else ""
        out.append(f"b{k} AS ({_best(k, where)}), l{k + 1} AS MATERIALIZED (SELECT v, coalesce(b{k}.cluster, l{k}.cluster) AS cluster FROM l{k} LEFT JOIN b{k} ON v = src)")
    return ", ".join(out)


def _draws(i: str, o: str, x: str, salt: str, more: str) -> str:
    """o: the rows of i with draw, a draw below PRIME of x; salt: a column, more: columns to keep."""
    first = f"SELECT {more}, {salt} AS s, ({x} % {PRIME} * 48271 + {salt} + 11) % {PRIME} AS h FROM {i}"
    second = f"SELECT {more}, (h * h + s * 3 + 7) % {PRIME} AS h FROM ({first})"
    third = f"SELECT {more}, (h * 69621 + 13) % {PRIME} AS h FROM ({second})"
    return f"{o} AS MATERIALIZED (SELECT {more}, (h * h + h) % {PRIME} AS draw FROM ({third}))"


#: Rounds that are more than any propagation over the test tables takes.
_MANY = 40


def _converged(adj: str, start: str, p: str = "") -> str:
    """l{p}{_MANY}: labels after so many rounds over adj (src, dst, w), in which halves move that each pair of
    rounds redraws. start: a table with the vertices v."""
    out = [_draws(start, f"h{p}0", "v", "0", "v")]
    for k in range(1, _MANY // 2):
        out += [_draws(f"h{p}{k - 1}", f"i{p}{k}", "draw", "0", "v"), f"h{p}{k} AS MATERIALIZED (SELECT v, (draw + v % {PRIME} * 69621) % {PRIME} AS draw FROM i{p}{k})"]
    out += [
        f"l{p}0 AS MATERIALIZED (SELECT v, v AS cluster FROM {start})",
    ]
    for r in range(_MANY):
        now = f"l{p}{r}"
        tally = f"SELECT e.src, n.cluster, sum(e.w) AS w FROM {adj} e JOIN h{p}{r // 2} h ON h.v = e.src AND h.draw % 2 = {r % 2} JOIN {now} n ON n.v = e.dst GROUP BY e.src, n.cluster"
        best = f"SELECT src, cluster FROM (SELECT t.src, t.cluster, row_number() OVER (PARTITION BY t.src ORDER BY round(t.w, 9) DESC, (t.cluster = m.cluster) DESC, t.cluster) AS r FROM ({tally}) t JOIN {now} m ON m.v = t.src) WHERE r = 1"
        out.append(f"l{p}{r + 1} AS MATERIALIZED (SELECT v, coalesce(b.cluster, o.cluster) AS cluster FROM {now} o LEFT JOIN ({best}) b ON o.v = b.src)")
    return ", ".join(out)


def _dense(of: str = "") -> str:
    return f"SELECT name, dense_rank() OVER (ORDER BY cluster) AS cluster FROM l{of}{_MANY} JOIN vx ON v = id"


def _first_seen(of: str = "") -> str:
    return f"SELECT name, dense_rank() OVER (ORDER BY f) AS cluster FROM (SELECT v, min(v) OVER (PARTITION BY cluster) AS f FROM l{of}{_MANY}) JOIN vx ON v = id"


_VS = "vs AS (SELECT id AS v FROM vx)"
_EMB = "g AS (SELECT 'e' || src AS src, 'e' || dst AS dst, round(w, 6) AS w FROM (SELECT a.vec_id AS src, b.vec_id AS dst, list_sum([x[1]::DOUBLE * x[2]::DOUBLE FOR x IN list_zip(a.embedding, b.embedding)]) AS w FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id) WHERE w > 0.3)"


def _graph(g: str) -> str:
    """vx, vs and the adjacency by number of the edges g."""
    vx = f"vx AS MATERIALIZED (SELECT name, row_number() OVER (ORDER BY length(name), name) - 1 AS id FROM (SELECT src AS name FROM {g} UNION SELECT dst FROM {g}))"
    return f"{vx}, {_VS}, e AS MATERIALIZED (SELECT a.id AS src, b.id AS dst, w FROM {g} JOIN vx a ON a.name = src JOIN vx b ON b.name = dst), adj AS MATERIALIZED (SELECT src, dst, w FROM e UNION ALL SELECT dst, src, w FROM e)"


_MAX = "{o} AS MATERIALIZED (SELECT src, dst, coalesce(w / nullif(max(w) OVER (PARTITION BY {by}src), 0), 0) AS w{more} FROM {i})"


def _consensus(rescaled: bool) -> str:
    """Labels of the consensus over `top`, an adjacency with maxima of 1, as lc{_MANY}."""
    slopes = ", ".join(f"({r}, {s!r}::DOUBLE)" for r, s in enumerate(SLOPES))
    out = [f"sl(run, slope) AS (VALUES {slopes})", "size AS (SELECT max(v) + 1 AS n FROM vs)"]
    out.append("cur AS MATERIALIZED (SELECT run, src, dst, 1 / (1 + exp(-slope * (w - 0.5::DOUBLE))) AS w FROM top, sl)")
    if rescaled:
        out.append("kept AS (SELECT run, src, dst, w / max(w) OVER (PARTITION BY run, src) AS w FROM cur)")
        out.append("cp AS MATERIALIZED (SELECT src + run * n AS src, dst + run * n AS dst, w FROM kept, size WHERE w >= 0.2::DOUBLE)")
    else:
        out.append("cp AS MATERIALIZED (SELECT src + run * n AS src, dst + run * n AS dst, CASE WHEN w > 0.2::DOUBLE THEN w ELSE 0.0::DOUBLE END AS w FROM cur, size)")
    out.append("vr AS MATERIALIZED (SELECT run * n + v AS v FROM vs, sl, size)")
    out.append(_converged("cp", "vr", "r"))
    out.append(f"ru AS MATERIALIZED (SELECT v // n AS run, v % n AS v, cluster FROM lr{_MANY}, size)")
    out.append("same AS MATERIALIZED (SELECT src, dst, sum((a.cluster = b.cluster)::INT) / {n}::DOUBLE AS w FROM (SELECT row_number() OVER () AS k, src, dst FROM adj) q JOIN ru a ON a.v = src JOIN ru b ON b.v = dst AND b.run = a.run GROUP BY k, src, dst)".format(n=len(SLOPES)))
    out.append(_converged("same", "vs", "c"))
    return ", ".join(out)


def _bootstrap() -> str:
    """Poisson draws by their distribution function, and samples without replacement."""
    steps, p, total = [], math.exp(-1.0), 0.0
    for k in range(12):
        total += p
        steps.append(total)
        p /= k + 1
    parts = ["n AS (SELECT row_number() OVER () - 1 AS id FROM lineitem)"]
    parts.append(f"s AS (SELECT id, t, (t * 48271) % {PRIME} AS salt FROM n, range(3) AS r(t))")
    parts.append(_draws("s", "d", "id", "salt", "id, t"))
    parts.append(f"u AS (SELECT t, draw / {PRIME}.0::DOUBLE AS u FROM d)")
    parts.append("c AS (SELECT t, " + " + ".join(f"(u >= '{x!r}'::DOUBLE)::BIGINT" for x in steps) + " AS copies FROM u)")
    return f"WITH {', '.join(parts)} SELECT t::INT AS tree, true AS replaced, sum(copies)::BIGINT AS drawn, count(*) FILTER (WHERE copies > 0) AS distinct_rows FROM c GROUP BY t UNION ALL SELECT t::INT, false, ceil(0.632 * count(*))::BIGINT, ceil(0.632 * count(*))::BIGINT FROM u GROUP BY t"


def _named(k: int) -> str:
    return f"SELECT name, cluster FROM l{k} JOIN vx ON v = id"


_RUNS = "runs AS (SELECT 0 AS run, * FROM l1 UNION ALL SELECT 1, * FROM l2 UNION ALL SELECT 2, * FROM l3)"
_SAME = f"{_IADJ}, {_rounds(3)}, c AS (SELECT src, dst, (a1.cluster = b1.cluster)::BIGINT + (a2.cluster = b2.cluster)::BIGINT + (a3.cluster = b3.cluster)::BIGINT AS n FROM adj " + " ".join(f"JOIN l{k} a{k} ON a{k}.v = src JOIN l{k} b{k} ON b{k}.v = dst" for k in (1, 2, 3)) + ")"
_FEATURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
_ID = "(l_orderkey * 8 + l_linenumber)"
_TREES = (
    "CASE WHEN l_quantity <= 25 THEN CASE WHEN l_discount <= 0.05 THEN 0.0 ELSE 1.0 END ELSE CASE WHEN l_tax <= 0.04 THEN 2.0 ELSE CASE WHEN l_extendedprice <= 30000 THEN 1.0 ELSE 0.0 END END END",
    "CASE WHEN l_extendedprice <= 20000 THEN 1.0 ELSE CASE WHEN l_quantity <= 40 THEN 2.0 ELSE 0.0 END END",
    "CASE WHEN l_discount <= 0.03 THEN 2.0 ELSE 1.0 END",
)
_VOTES = f"v AS (SELECT {_ID} AS id, l_returnflag, " + ", ".join(f"(({_TREES[0]} = {i})::INT + ({_TREES[1]} = {i})::INT + ({_TREES[2]} = {i})::INT) / 3.0::DOUBLE AS v{c}" for i, c in enumerate("ANR")) + " FROM lineitem)"


def _gini(of: str) -> str:
    return f"1 - ({' + '.join(f'power(count(*) FILTER (WHERE {of} = {chr(39)}{c}{chr(39)}) / count(*)::DOUBLE, 2)' for c in 'ANR')})"


_CELLS = " UNION ALL ".join(f"SELECT '{f}' AS feature, {f} AS value, l_returnflag AS y FROM lineitem" for f in _FEATURES)
_LEAF = "{q} - {s} * {s} / {n}"
_X = ("(l_quantity / 50.0)", "(l_extendedprice / 100000.0)", "(l_discount / 0.1)", "(l_tax / 0.08)")
_HIDDEN = [f"tanh({b} + " + " + ".join(f"({w}) * {x}" for w, x in zip(ws, _X, strict=True)) + ")" for b, ws in ((0.1, (0.5, -0.25, 0.75, 0.1)), (-0.2, (-0.6, 0.4, 0.2, -0.3)), (0.05, (0.3, 0.3, -0.5, 0.8)))]
_OUT = f"(1 / (1 + exp(-(-0.1 + 0.7 * {_HIDDEN[0]} - 0.2 * {_HIDDEN[1]} + 0.4 * {_HIDDEN[2]}))))"

def _mlp(passes: int, rate: float = 0.5) -> str:
    """Full-batch descent steps of a 4-4-1 network of logistic units, then its outputs."""
    net = Network.init([4, 4, 1])
    (a, v), (b, c) = net.weights, net.biases
    params = {f"a{j}_{k}": a[j, k] for j in range(4) for k in range(4)} | {f"b{j}": b[j] for j in range(4)} | {f"v{j}": v[0, j] for j in range(4)} | {"c": c[0]}
    out = [f"x AS MATERIALIZED (SELECT {_ID} AS id, {', '.join(f'{x} AS x{k}' for k, x in enumerate(_X))}, l_quantity / 50.0 * 0.5::DOUBLE + l_discount / 0.1 * 0.3::DOUBLE AS y FROM lineitem)"]
    out.append("p0 AS (SELECT " + ", ".join(f"'{float(x)!r}'::DOUBLE AS {n}" for n, x in params.items()) + ")")
    for s in range(passes + 1):
        hidden = ", ".join(f"1 / (1 + exp(-(b{j} + {' + '.join(f'a{j}_{k} * x{k}' for k in range(4))}))) AS h{j}" for j in range(4))
        out.append(f"h{s} AS (SELECT *, {hidden} FROM x, p{s}), o{s} AS (SELECT *, 1 / (1 + exp(-(c + {' + '.join(f'v{j} * h{j}' for j in range(4))}))) AS o FROM h{s})")
        if s < passes:
            step = lambda n, g: f"any_value({n}) - {rate} * avg({g}) AS {n}"
            grads = [step(f"a{j}_{k}", f"d * v{j} * h{j} * (1 - h{j}) * x{k}") for j in range(4) for k in range(4)]
            grads += [step(f"b{j}", f"d * v{j} * h{j} * (1 - h{j})") for j in range(4)] + [step(f"v{j}", f"d * h{j}") for j in range(4)] + [step("c", "d")]
            out.append(f"p{s + 1} AS MATERIALIZED (SELECT {', '.join(grads)} FROM (SELECT *, (o - y) * o * (1 - o) AS d FROM o{s}))")
    return f"WITH {', '.join(out)} SELECT id, round(o, 6) AS output FROM o{passes}"


_GINI = f"""c AS ({_CELLS}), u AS (SELECT feature, value, {", ".join(f"count(*) FILTER (WHERE y = '{k}') AS n{k}" for k in "ANR")} FROM c GROUP BY ALL),
w AS (SELECT feature, value, {", ".join(f"sum(n{k}) OVER (PARTITION BY feature ORDER BY value)::DOUBLE AS l{k}, sum(n{k}) OVER (PARTITION BY feature)::DOUBLE AS t{k}" for k in "ANR")} FROM u),
s AS (SELECT *, lA + lN + lR AS nl, tA + tN + tR AS nt FROM w),
g AS (SELECT feature, value, (1 - (tA*tA + tN*tN + tR*tR) / (nt*nt)) - nl / nt * (1 - (lA*lA + lN*lN + lR*lR) / (nl*nl)) - (nt - nl) / nt * (1 - ((tA-lA)*(tA-lA) + (tN-lN)*(tN-lN) + (tR-lR)*(tR-lR)) / ((nt-nl)*(nt-nl))) AS gain FROM s WHERE nt > nl)"""


def _sse(features: tuple[str, ...], y: str, group: str) -> str:
    """g: the gain of each split in squared errors; group: a column, or a constant AS its name."""
    by = group.rsplit(" ", 1)[-1]
    cells = " UNION ALL ".join(f"SELECT {group}, '{f}' AS feature, {f} AS value, {y} AS y FROM lineitem" for f in features)
    return f"""c AS ({cells}),
u AS (SELECT {by}, feature, value, count(*)::DOUBLE AS n, sum(y) AS s, sum(y * y) AS q FROM c GROUP BY ALL),
w AS (SELECT *, {", ".join(f"sum({k}) OVER (PARTITION BY {by}, feature ORDER BY value) AS l{k}, sum({k}) OVER (PARTITION BY {by}, feature) AS t{k}" for k in "nsq")} FROM u),
g AS (SELECT {by}, feature, value, (tq - ts*ts/tn) - (lq - ls*ls/ln) - ((tq-lq) - (ts-ls)*(ts-ls)/(tn-ln)) AS gain FROM w WHERE tn > ln)"""


_CP = _MAX.format(o="top", i="adj", by="", more="")


def _tree(splits: str, leaf: str, rows: str) -> str:
    """Nodes of a tree of depth 1: the best of all splits (feature, value, gain), and both leaves."""
    side = "CASE {f} END".format(f=" ".join(f"WHEN feature = '{f}' THEN {f}" for f in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")))
    return f"""WITH {splits}, b AS (SELECT feature, value FROM g ORDER BY gain DESC LIMIT 1),
r AS (SELECT {side} <= value AS goes_left, {rows} FROM lineitem, b),
v AS (SELECT goes_left, {leaf} AS leaf_value FROM r GROUP BY goes_left)
SELECT 0 AS node_id, feature, round(value, 6) AS threshold, NULL::DOUBLE AS leaf_value FROM b
UNION ALL SELECT CASE WHEN goes_left THEN 1 ELSE 2 END, NULL, NULL, round(leaf_value, 4) FROM v"""


ORACLES = {
    "lp_round1": f"WITH {_IADJ}, {_rounds(1, False)} {_named(1)}",
    "edges_supplier_part": f"WITH {_GA} SELECT * FROM ga",
    "edges_customer_supplier": f"WITH {_GB} SELECT * FROM gb",
    "edges_similarity": "SELECT 'e' || src AS src, 'e' || dst AS dst, round(w, 6) AS w FROM (SELECT a.vec_id AS src, b.vec_id AS dst, list_sum([x[1]::DOUBLE * x[2]::DOUBLE FOR x IN list_zip(a.embedding, b.embedding)]) AS w FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id) WHERE w > 0.3",
    "edgelist_roundtrip": f"WITH {_GA} SELECT * FROM ga",
    "edges_ignore_weights": f"WITH {_GB} SELECT src, dst, 1.0::DOUBLE AS w FROM gb",
    "vertex_index": f"WITH {_GA}, {_VX} SELECT name, id FROM vx",
    "vertex_degree": f"WITH {_ADJ} SELECT src AS name, count(*) AS degree FROM adj GROUP BY src",
    "directed_out_degree": f"WITH {_GA}, {_VX} SELECT name, count(src) AS degree FROM vx LEFT JOIN ga ON src = name GROUP BY name",
    "csr_offsets": f"WITH {_IADJ}, d AS (SELECT id, count(src) AS degree FROM vx LEFT JOIN adj ON src = id GROUP BY id) SELECT id, degree, (sum(degree) OVER (ORDER BY id) - degree)::BIGINT AS \"offset\" FROM d",
    "self_loops": f"WITH {_GB}, {_BOTH.format(g='gb')}, a AS (SELECT * FROM adj UNION ALL SELECT DISTINCT src, src, 2.0 FROM adj) SELECT src, count(*) AS degree, sum(w) AS w FROM a GROUP BY src",
    "self_loops_after_max_norm": f"WITH {_GB}, {_BOTH.format(g='gb')}, m AS (SELECT src, max(w) AS m FROM adj GROUP BY src) SELECT src, count(*) + 1 AS degree, round(sum(w / m) + 0.5, 6) AS w FROM adj JOIN m USING (src) GROUP BY src",
    "weights_sum_norm": f"WITH {_ADJ} SELECT src, dst, round(w / sum(w) OVER (PARTITION BY src), 10) AS w FROM adj",
    "weights_max_norm": f"WITH {_ADJ} SELECT src, dst, round(w / max(w) OVER (PARTITION BY src), 6) AS w FROM adj",
    "parallel_edge_tally": "WITH e AS (SELECT 's' || l_suppkey AS src, 'p' || l_partkey AS dst, l_quantity AS w FROM lineitem) SELECT src, dst, count(*) AS n, sum(w) AS w FROM (SELECT * FROM e UNION ALL SELECT dst, src, w FROM e) GROUP BY src, dst",
    "sigmoid_weights": f"WITH {_ADJ}, n AS (SELECT src, dst, 1 / (1 + exp(-4.0 * (w / sum(w) OVER (PARTITION BY src) - 0.5))) AS r FROM adj) SELECT src, dst, CASE WHEN r > 0.2 THEN round(r, 6) ELSE 0.0 END AS w FROM n",
    "sigmoid_rescaled_cutoff": f"WITH {_ADJ}, n AS (SELECT src, dst, 1 / (1 + exp(-2.0 * (w / max(w) OVER (PARTITION BY src) - 0.5))) AS r FROM adj), m AS (SELECT src, dst, r / max(r) OVER (PARTITION BY src) AS w FROM n) SELECT src, dst, round(w, 6) AS w FROM m WHERE w >= 0.55",
    "activations": "WITH r AS (SELECT l_orderkey, l_linenumber, l_discount * 40 - 2 AS x FROM lineitem) SELECT l_orderkey, l_linenumber, round(greatest(x, 0.0), 6) AS relu, CASE WHEN x > 0 THEN 1.0::DOUBLE ELSE 0.0 END AS relu_slope, round(1 / (1 + exp(-x)), 6) AS sigmoid, round((1 / (1 + exp(-x))) * (1 - 1 / (1 + exp(-x))), 6) AS sigmoid_slope, round(ln(1 + exp(x)), 6) AS softplus, round(1 / (1 + exp(-x)), 6) AS softplus_slope, round(tanh(x), 6) AS tanh, round(1 - tanh(x) * tanh(x), 6) AS tanh_slope, round(x, 6) AS identity, 1.0::DOUBLE AS identity_slope FROM r",
    "losses": "WITH r AS (SELECT l_orderkey, l_linenumber, l_discount * 10 AS e, l_tax * 10 AS o FROM lineitem) SELECT l_orderkey, l_linenumber, round(0.5 * (e - o) * (e - o), 6) AS squared, round(e - o, 6) AS squared_slope, round(abs(e - o), 6) AS absolute, sign(e - o)::DOUBLE AS absolute_slope FROM r",
    "label_tally": f"WITH {_IADJ}, {_rounds(1)} {_tally(1)}",
    "label_argmax": f"WITH {_IADJ}, {_rounds(1)} SELECT src AS v, cluster FROM ({_best(1)})",
    "frontier": f"WITH {_IADJ}, {_rounds(2)} SELECT DISTINCT src AS v FROM adj JOIN l2 n ON n.v = dst JOIN l1 o ON o.v = dst JOIN l2 m ON m.v = src WHERE n.cluster <> o.cluster AND m.cluster <> n.cluster",
    "lp_fixed_rounds": f"WITH {_IADJ}, {_rounds(4)} {_named(4)}",
    "lp_directed_rounds": f"WITH {_DADJ}, {_rounds(4)} {_named(4)}",
    "lp_strongest_start": f"WITH {_IADJ} SELECT src AS v, dst AS cluster FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS r FROM adj) WHERE r = 1",
    "relabel_dense": f"WITH {_IADJ}, {_rounds(2)} SELECT v, dense_rank() OVER (ORDER BY cluster) AS cluster FROM l2",
    "relabel_first_seen": f"WITH {_IADJ}, {_rounds(2)}, f AS (SELECT v, min(v) OVER (PARTITION BY cluster) AS f FROM l2) SELECT v, dense_rank() OVER (ORDER BY f) AS cluster FROM f",
    "community_sizes": f"WITH {_IADJ}, {_rounds(4)} SELECT cluster, count(*) AS size FROM l4 GROUP BY cluster",
    "deparse_communities": 'SELECT n_name AS name, n_regionkey + 1 AS "group" FROM nation',
    "modularity": f"WITH {_IADJ}, {_rounds(4)}, p AS (SELECT a.cluster AS ca, b.cluster AS cb, w FROM adj JOIN l4 a ON a.v = src JOIN l4 b ON b.v = dst), k AS (SELECT ca, sum(w) AS k FROM p GROUP BY ca) SELECT round((SELECT sum(w) FILTER (WHERE ca = cb) / sum(w) FROM p) - (SELECT sum(k * k) FROM k) / (SELECT sum(w) * sum(w) FROM p), 9) AS modularity",
    "comembership_edges": f"WITH {_SAME} SELECT * FROM c",
    "comembership_pairs": "WITH r AS (SELECT 0 AS run, n_nationkey AS v, n_regionkey AS c FROM nation UNION ALL SELECT 1, n_nationkey, n_nationkey % 3 FROM nation UNION ALL SELECT 2, n_nationkey, length(n_name) % 4 FROM nation) SELECT a.v AS v1, b.v AS v2, round(count(*) / 3.0::DOUBLE, 6) AS w FROM r a JOIN r b ON a.run = b.run AND a.c = b.c GROUP BY 1, 2",
    "consensus_weights": f"WITH {_SAME} SELECT src, round(sum(n / 3.0::DOUBLE), 6) AS w, count(*) FILTER (WHERE n > 0) AS kept FROM c GROUP BY src",
    "gini_impurity": f"SELECT l_linestatus, round({_gini('l_returnflag')}, 6) AS gini FROM lineitem GROUP BY l_linestatus",
    "gini_best_split": f"WITH {_GINI}\n    SELECT feature, value AS threshold, round(gain, 9) AS gain FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY round(gain, 9) DESC, value) AS r FROM g) WHERE r = 1",
    "sse_best_split": f"WITH {_sse(('l_discount', 'l_tax', 'l_extendedprice'), 'l_quantity', 'l_returnflag')}\n    SELECT l_returnflag, feature, value AS threshold, round(gain, 2) AS gain FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag, feature ORDER BY round(gain, 9) DESC, value) AS r FROM g) WHERE r = 1",
    "tree_fit_classify": _tree(_GINI, "(list_position(['A', 'N', 'R'], mode(l_returnflag)) - 1)::DOUBLE", "l_returnflag"),
    "tree_fit_regress": _tree(_sse(("l_quantity", "l_discount", "l_tax"), "l_extendedprice", "1 AS one"), "avg(l_extendedprice)", "l_extendedprice"),
    "forest_votes_sum": "SELECT row_number() OVER () - 1 AS id, 1.0::DOUBLE AS votes, 3 AS classes FROM lineitem",
    "forest_regression": "SELECT row_number() OVER () - 1 AS id, true AS within FROM lineitem",
    "dendrogram_nodes": "SELECT * FROM (VALUES (0, 0, 5, 4.0::DOUBLE, 1.625::DOUBLE), (0, 1, 2, 3.0, 0.5), (0, 2, 3, 3.0, 2.75), (0, 3, 1, 0.0, 0.0), (0, 4, 1, 0.0, 1.0), (0, 5, 1, 0.0, 2.0), (0, 6, 2, 2.0, 3.5), (0, 7, 1, 0.0, 3.0), (0, 8, 1, 0.0, 4.0), (1, 0, 3, 3.0, 0.75), (1, 1, 1, 0.0, 0.0), (1, 2, 2, 2.0, 1.5), (1, 3, 1, 0.0, 1.0), (1, 4, 1, 0.0, 2.0), (2, 0, 2, 2.0, 0.5), (2, 1, 1, 0.0, 0.0), (2, 2, 1, 0.0, 1.0)) t(tree_id, node_id, members, height, midpoint)",
    "bootstrap_sizes": _bootstrap(),
    "mlp_train": _mlp(3),
    "sigmoid_negative_slope": f"WITH {_ADJ} SELECT src, dst, 0.0::DOUBLE AS w FROM adj",
    "edge_sample": f"WITH {_GA}, {_graph('ga')}, dg AS (SELECT src, count(*) AS degree FROM adj GROUP BY src), i AS (SELECT adj.*, degree, 0 AS salt FROM adj JOIN dg USING (src)), {_draws('i', 'd', '(src * 31 + dst)', 'salt', 'src, dst, w, degree')} SELECT src, dst, w FROM d WHERE draw / {PRIME}.0::DOUBLE < 5.0::DOUBLE / degree",
    "lp_converged": f"WITH {_GA}, {_graph('ga')}, {_converged('adj', 'vs')} {_dense()}",
    "flp_out_of_core": f"WITH {_GA}, {_graph('ga')}, nrm AS MATERIALIZED (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS w FROM adj), {_converged('nrm', 'vs')} {_first_seen()}",
    "flp_in_memory": f"WITH {_GB}, {_graph('gb')}, {_CP}, lo AS MATERIALIZED (SELECT * FROM top UNION ALL SELECT v, v, 0.5::DOUBLE FROM vs), {_converged('lo', 'vs')} {_first_seen()}",
    "consensus_clusters": f"WITH {_EMB}, {_graph('g')}, {_CP}, {_consensus(False)} {_dense('c')}",
    "flp_consensus_rescaled": f"WITH {_EMB}, {_graph('g')}, {_CP}, {_consensus(True)} {_first_seen('c')}",
    "majority_class": "SELECT l_suppkey, l_returnflag AS class, n FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_returnflag) AS r FROM (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2)) WHERE r = 1",
    "tabulate": f'SELECT l_quantity AS value, count(*) AS n, min({_ID}) AS "first" FROM lineitem GROUP BY l_quantity',
    "stump_classify": f"WITH r AS (SELECT CASE WHEN l_quantity <= 25 THEN 'left' ELSE 'right' END AS side, l_returnflag AS f FROM lineitem), g AS (SELECT side, round({_gini('f')}, 6) AS gini FROM r GROUP BY side), m AS (SELECT side, f, count(*) AS n FROM r GROUP BY side, f) SELECT side, f AS class, n, gini FROM (SELECT *, row_number() OVER (PARTITION BY side ORDER BY n DESC, f) AS k FROM m) JOIN g USING (side) WHERE k = 1",
    "stump_regress": "SELECT CASE WHEN l_quantity <= 25 THEN 'left' ELSE 'right' END AS side, round(avg(l_extendedprice), 4) AS mean, count(*) AS n FROM lineitem GROUP BY 1",
    "tree_predict_fixed": f"SELECT {_ID} AS id, ({_TREES[0]})::DOUBLE AS leaf FROM lineitem",
    "forest_vote_fraction": f"WITH {_VOTES} SELECT id, " + ", ".join(f"round(v{c}, 6) AS vote_{c}" for c in "ANR") + " FROM v",
    "forest_mean": f"SELECT {_ID} AS id, round((({_TREES[0]}) + ({_TREES[1]}) + ({_TREES[2]}))::DOUBLE / 3, 6) AS prediction FROM lineitem",
    "confusion_matrix": f"WITH {_VOTES} SELECT l_returnflag AS truth, CASE WHEN vA >= vN AND vA >= vR THEN 'A' WHEN vN >= vR THEN 'N' ELSE 'R' END AS predicted, count(*) AS n FROM v GROUP BY 1, 2",
    "tree_describe": "SELECT * FROM (VALUES (0, 5::BIGINT, 4::BIGINT, 3), (1, 3, 2, 2), (2, 2, 1, 1)) t(tree_id, leaves, internal, depth)",
    "mlp_forward_fixed": f"SELECT {_ID} AS id, round({_OUT}, 6) AS output FROM lineitem",
    "mlp_loss_fixed": f"SELECT l_returnflag, round(avg(0.5 * power({_OUT} - (l_returnflag = 'N')::INT, 2)), 6) AS loss FROM lineitem GROUP BY l_returnflag",
}
