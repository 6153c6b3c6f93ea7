"""Work on all pairs of an asset's vectors, none of them listed.

Vectors are dealt into blocks by hash. Every pair of blocks is one group; a task multiplies
the two blocks strip by strip and passes on counts, a maximum or the nearest two only. An exact
order statistic takes two passes, one over the upper digits of the similarities and one
over the lower digits around the rank.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediasift.functions.exprs import norm
from mediasift.session import durable

# similarities are told apart to the ninth place; a digit has 16 bits
SCALE, BITS = 1e9, 16
# vectors in a block, blocks of an asset before they grow, and how far they do
ROWS, BLOCKS, GROWTH = 8192, 16, 4
# values of one strip of a product, and exactly computed pairs at a time
STRIP, EXACT = 1 << 20, 1 << 16
# most per-key rows that are sent to every executor
BROADCAST_ROWS = 1_000_000


def dealt(df: DataFrame, keys: Sequence[str], vec: str, by: Column, rows: int = ROWS) -> DataFrame:
    """``df`` with ``_w`` (vector length), ``_b`` (block) and ``_g`` (blocks of the asset), written once.

    ``by`` deals an asset's vectors. A block has ``rows`` vectors on average, up to ``GROWTH`` times that once an
    asset has ``BLOCKS`` blocks: a vector is copied once per block of its asset.
    """
    d = df.withColumn("_w", F.size(vec))
    g = F.ceil(F.col("_n") / rows)
    g = F.when(g > BLOCKS, F.greatest(F.lit(BLOCKS), F.ceil(F.col("_n") / (GROWTH * rows)))).otherwise(g)
    n = d.groupBy(*keys, "_w").agg(F.count(F.lit(1)).alias("_n")).select(*keys, "_w", g.cast("int").alias("_g"))
    return durable(few(d, n, [*keys, "_w"]).withColumn("_b", F.pmod(F.xxhash64(by), F.col("_g")).cast("int")))


def pair_groups(blocks: DataFrame, keys: Sequence[str]):
    """Group of every pair of blocks, each pair once; both blocks' vectors are its rows."""
    own = F.col("_b")
    places = F.transform(F.sequence(F.lit(0), F.col("_g") - 1), lambda o: F.struct(F.least(own, o).alias("i"), F.greatest(own, o).alias("j")))
    e = blocks.withColumn("_p", F.explode(places)).withColumns({"_i": F.col("_p.i"), "_j": F.col("_p.j")}).drop("_p", "_g")
    return e.groupBy(*keys, "_w", "_i", "_j")


def sides(t: pa.Table, vec: str) -> tuple[pa.Table, np.ndarray, pa.Table, np.ndarray, bool]:
    """(rows, matrix) of the first and the second block, and whether they are the same block."""
    own, i, j = (t[c].to_numpy() for c in ("_b", "_i", "_j"))

    def side(at):
        s = t.take(pa.array(np.flatnonzero(own == at)))
        m = s[vec].combine_chunks()
        m = m.flatten() if isinstance(m, pa.ListArray) else pa.concat_arrays([c.flatten() for c in m.chunks])
        return s, m.to_numpy(zero_copy_only=False).astype(float).reshape(len(s), -1)

    a = side(i[0])
    return (*a, *a, True) if i[0] == j[0] else (*a, *side(j[0]), False)


def strips(a: np.ndarray, b: np.ndarray, once: bool) -> Iterator[tuple[slice, slice, np.ndarray]]:
    """(rows of a, rows of b, their products); of a block with itself (``once``) the part right of each strip's first row."""
    step = max(1, STRIP // max(1, len(b)))
    for r in range(0, len(a), step):
        rows, cols = slice(r, min(r + step, len(a))), slice(r if once else 0, len(b))
        yield rows, cols, a[rows] @ b[cols].T


def upper(s: np.ndarray, once: bool) -> np.ndarray:
    """Places of a strip whose pair is met here: all, or those above the diagonal."""
    return np.arange(s.shape[1])[None, :] > np.arange(s.shape[0])[:, None] if once else np.ones(s.shape, bool)


def in_order(a: np.ndarray, b: np.ndarray, term: Callable) -> np.ndarray:
    """Sum of ``term`` over the components, added one after the other as the array expressions do."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        out += term(a[:, k], b[:, k])
    return out


def _units(m: np.ndarray) -> np.ndarray:
    return m / np.sqrt((m * m).sum(axis=1))[:, None]


def _similar(t: pa.Table, vec: str, gap: float) -> Iterator[np.ndarray]:
    """Similarities of the pairs of a group that are more than ``gap`` positions apart."""
    ta, a, tb, b, once = sides(t, vec)
    ia, ib, a, b = ta["_at"].to_numpy(), tb["_at"].to_numpy(), _units(a), _units(b)
    for rows, cols, s in strips(a, b, once):
        yield s[upper(s, once) & (np.abs(ia[rows, None] - ib[None, cols]) > gap)]


def _each(blocks: DataFrame, keys: Sequence[str], fn: Callable, schema: str) -> DataFrame:
    """``fn(group)`` gives columns; the keys go before them."""
    kind = {f.name: f.dataType.simpleString() for f in blocks.schema.fields}
    keys = list(keys)

    def one(t: pa.Table) -> pa.Table:
        cols = {c: pa.array(v) for c, v in fn(t).items()}
        n = len(next(iter(cols.values())))
        return pa.table({**{k: pa.repeat(t[k][0], n) for k in keys}, **cols})

    return pair_groups(blocks, keys).applyInArrow(one, ", ".join([*[f"`{k}` {kind[k]}" for k in keys], schema]))


def pair_median(blocks: DataFrame, keys: Sequence[str], vec: str, gap: float, centre: DataFrame | None = None) -> DataFrame:
    """(keys, n_pairs, median) of |similarity - c| over all pairs; ``centre`` is (keys, c), without it of the similarity.

    Counts of the upper digits find the digits of the two middle ranks, counts of
    the values under these digits the two values; either has at most 131,072
    different values for an asset. Assets without a pair give no row.
    """
    p = blocks.withColumn("c", F.lit(-1.0)) if centre is None else few(blocks, centre, keys)
    top = _counts(p, keys, vec, gap, True)
    w = Window.partitionBy(*keys).orderBy("d")
    t = top.withColumns({"_c": F.sum("n").over(w), "_t": F.sum("n").over(Window.partitionBy(*keys))})
    r1, r2 = F.floor((F.col("_t") - 1) / 2), F.floor(F.col("_t") / 2)
    at = lambda r: (F.col("_c") - F.col("n") <= r) & (r < F.col("_c"))
    pick = lambda r, c: F.max(F.when(at(r), c))
    before = F.col("_c") - F.col("n")
    mid = t.groupBy(*keys).agg(F.max("_t").alias("n_pairs"), pick(r1, F.col("d")).alias("h1"), pick(r2, F.col("d")).alias("h2"), pick(r1, r1 - before).alias("r1"), pick(r2, r2 - before).alias("r2"))
    mid = durable(mid)
    low = _counts(few(p, mid.select(*keys, "h1", "h2"), keys), keys, vec, gap, False)
    h = F.shiftright("d", BITS)
    u = low.withColumn("_c", F.sum("n").over(Window.partitionBy(*keys, h).orderBy("d")))
    u = per_key(u, mid, keys, "inner")
    value = lambda k: F.max(F.when((h == F.col(f"h{k}")) & at(F.col(f"r{k}")), F.col("d")))
    g = u.groupBy(*keys).agg(F.max("n_pairs").alias("n_pairs"), ((value(1) + value(2)) / (2 * SCALE)).alias("median"))
    return g.withColumn("median", F.col("median") - 1) if centre is None else g


def _counts(blocks: DataFrame, keys: Sequence[str], vec: str, gap: float, top: bool) -> DataFrame:
    """(keys, d, n): counts of the upper digits, or of the values under two of them."""

    def counts(t: pa.Table) -> dict:
        c = t["c"][0].as_py()
        bases = [0] if top else sorted({t[h][0].as_py() for h in ("h1", "h2")})
        size = (int(2.1 * SCALE) >> BITS) + 1 if top else 1 << BITS
        n = np.zeros((len(bases), size), np.int64)
        for s in _similar(t, vec, gap):
            v = np.rint(np.abs(s - c) * SCALE).astype(np.int64)
            for i, h in enumerate(bases):
                n[i] += np.bincount(v >> BITS if top else v[v >> BITS == h] - (h << BITS), minlength=size)
        i, d = np.nonzero(n)
        return {"d": d + (np.asarray(bases, np.int64)[i] << BITS), "n": n[i, d]}

    return _each(blocks, keys, counts, "d long, n long").groupBy(*keys, "d").agg(F.sum("n").alias("n"))


def repeats_adaptive(
    df: DataFrame, keys: Sequence[str], ident: str, vec: str, gap: float = 5, least: float = 0.970, most: float = 0.9995, fixed: float = 0.995, factor: float = 3.5, min_span: float = 60, min_pairs: int = 20, min_hits: int = 3, rows: int = ROWS
) -> DataFrame:
    """Pairs of windows more than ``gap`` positions apart that are alike beyond the asset's own spread.

    The cut is median + ``factor`` x 1.4826 MAD of all pair similarities, kept inside
    ``least``..``most``; assets spanning under ``min_span`` positions or with under ``min_pairs`` pairs
    take ``fixed``. ``ident`` is a distinct whole-number position per asset; null and zero vectors and
    null positions take no part. Assets without a pair give a row with zeros. The
    work grows with the square of an asset's windows, spread over pairs of blocks of ``rows`` windows.
    """
    use = df.filter(F.col(ident).isNotNull() & (norm(F.col(vec)) > 0))
    n = use.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), (F.max(ident) - F.min(ident)).alias("_span"))
    blocks = dealt(use.select(*keys, F.col(ident).cast("bigint").alias("_at"), F.col(vec).alias("_u")), keys, "_u", F.col("_at"), rows)
    med = durable(pair_median(blocks, keys, "_u", gap))
    mad = pair_median(blocks, keys, "_u", gap, med.select(*keys, F.col("median").alias("c"))).select(*keys, F.col("median").alias("mad"))
    j = per_key(per_key(n, med, keys), mad, keys)
    own = F.least(F.lit(most), F.greatest(F.lit(least), F.col("median") + factor * 1.4826 * F.col("mad")))
    j = durable(j.withColumn("cut", F.when((F.col("_span") >= min_span) & (F.col("n_pairs") >= min_pairs), own).otherwise(F.lit(fixed))))

    def hits(t: pa.Table) -> dict:
        cut, n, top = t["cut"][0].as_py(), 0, None
        for s in _similar(t, "_u", gap):
            n += int((s >= cut).sum())
            top = max(top if top is not None else -2.0, float(s.max())) if len(s) else top
        return {"n": [n], "top": pa.array([top], pa.float64())}

    h = _each(few(blocks, j.select(*keys, "cut"), keys), keys, hits, "n long, top double")
    h = h.groupBy(*keys).agg(F.sum("n").alias("n_hits"), F.max("top").alias("max_similarity"))
    out = per_key(j, h, keys)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint"))
    return out.select(*keys, "n", zero("n_pairs").alias("n_pairs"), "median", "mad", "cut", zero("n_hits").alias("n_hits"), "max_similarity", (zero("n_hits") >= min_hits).alias("flagged"))


def alike(d: DataFrame, keys: Sequence[str], unit: str, cut: float, gap: float, rows: int = ROWS) -> DataFrame:
    """(keys, _o, _ox) of distinct unit vectors: pairs with cosine >= ``cut`` by their counts, and the best of far ones.

    ``d`` is (keys, unit, _m, _lo, _hi): a vector, how often it stands, its first and last position.
    """

    def hits(t: pa.Table) -> dict:
        ta, a, tb, b, once = sides(t, unit)
        (ma, la, ha), (mb, lb, hb) = ([x[c].to_numpy().astype(float) for c in ("_m", "_lo", "_hi")] for x in (ta, tb))
        n, top = 0, None
        for rows, cols, s in strips(a, b, once):
            # next to the cut the sum is taken in the order of the other steps, so all of them agree
            near = np.flatnonzero(np.abs(s - cut) <= 1e-12)
            for at in range(0, len(near), EXACT):
                x, y = np.divmod(near[at : at + EXACT], s.shape[1])
                s[x, y] = in_order(a[rows][x], b[cols][y], np.multiply)
            hit = (s >= cut) & upper(s, once)
            n += int((ma[rows] * (hit @ mb[cols])).sum())
            # two sets of positions hold a far pair exactly when their outer ends are far apart
            x, y = np.nonzero(hit)
            for at in range(0, len(x), STRIP):
                p, q = x[at : at + STRIP], y[at : at + STRIP]
                far = s[p, q][np.maximum(ha[rows][p] - lb[cols][q], hb[cols][q] - la[rows][p]) > gap]
                top = max(top if top is not None else -2.0, float(far.max())) if len(far) else top
        return {"_o": [n], "_ox": pa.array([top], pa.float64())}

    h = _each(dealt(d, keys, unit, F.col(unit), rows), keys, hits, "_o long, _ox double")
    return h.groupBy(*keys).agg(F.sum("_o").alias("_o"), F.max("_ox").alias("_ox"))


def nearest_two(d: DataFrame, keys: Sequence[str], vec: str, rows: int = ROWS) -> DataFrame:
    """(keys, _q, _near) of distinct vectors: the nearest two others as array of (_d, _lo, _m), ties to the smaller ``_lo``.

    ``d`` is (keys, vec, _m, _lo), ``_lo`` tells the vectors of an asset apart. Products only choose
    whom to look at; distances are sums of squared differences.
    """

    def two(ids, m, other, a, b, na, nb, s, skip, out):
        """Candidates of the rows of ``s`` (squared distances by products): all that rounding could put among the first two."""
        s = np.where(skip, np.inf, s) if skip is not None else s
        k = min(2, s.shape[1])
        slack = 1e-12 * (na + nb.max())
        x, y = np.nonzero((s <= (np.partition(s, k - 1, axis=1)[:, k - 1] + slack)[:, None]) & np.isfinite(s))
        dist = np.empty(len(x))
        for at in range(0, len(x), EXACT):
            p, q = x[at : at + EXACT], y[at : at + EXACT]
            dist[at : at + EXACT] = np.sqrt(in_order(a[p], b[q], lambda u, v: (v - u) * (v - u)))
        order = np.lexsort((other[y], dist, x))
        x, y, dist = x[order], y[order], dist[order]
        rank = np.arange(len(x)) - np.searchsorted(x, x)
        x, y, dist = x[rank < 2], y[rank < 2], dist[rank < 2]
        out.append((ids[x], dist, other[y], m[y]))

    def found(t: pa.Table) -> dict:
        ta, a, tb, b, once = sides(t, vec)
        (ia, ma), (ib, mb) = ([x[c].to_numpy() for c in ("_lo", "_m")] for x in (ta, tb))
        na, nb = (a * a).sum(axis=1), (b * b).sum(axis=1)
        out = []
        for p, np_, i, q, nq, j, mq in ((a, na, ia, b, nb, ib, mb), (b, nb, ib, a, na, ia, ma))[: 1 if once else 2]:
            for rows, cols, s in strips(p, q, False):
                s = np_[rows, None] + nq[None, :] - 2 * s
                two(i[rows], mq, j, p[rows], q, np_[rows], nq, s, i[rows, None] == j[None, :] if once else None, out)
        c = [np.concatenate(v) for v in zip(*out)]
        return dict(zip(("_q", "_d", "_lo", "_m"), c))

    h = _each(dealt(d, keys, vec, F.col(vec), rows), keys, found, "_q long, _d double, _lo long, _m long")
    return h.groupBy(*keys, "_q").agg(F.slice(F.sort_array(F.collect_list(F.struct("_d", "_lo", "_m"))), 1, 2).alias("_near"))


def few(rows: DataFrame, one: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join of one row per key to many; up to a counted size the keys are broadcast."""
    one = durable(one)
    return per_key(rows, F.broadcast(one) if one.count() <= BROADCAST_ROWS else one, keys, "inner")


def per_key(rows: DataFrame, one: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join one row per key, null keys too."""
    r = one.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return rows.join(r, cond, how).drop(*[f"_r_{k}" for k in keys])
