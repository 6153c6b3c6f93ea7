"""N-gram Jaccard join: blocked sparse product of the document by n-gram incidence matrix."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mediasift.llm.common import few_files, written
from mediasift.llm.decontamination import BROADCAST_ROWS, small

# A column is multiplied out when it has at most this many pairs per set between classes.
PAIRS_PER_SET = 8
# A column of at most this many sets is multiplied out at once, without rounds.
COLUMN_SETS = 64
# Rounds of pivots; what a column has left after them, or after one that links nothing, is multiplied out.
PIVOT_ROUNDS = 5
# A row is written as its difference from a reference row up to this many times the difference of a link.
REFERENCE_REACH = 3
# Most frequent n-grams that are known as such and go last in the order of columns (8 bytes each).
FREQUENT = 100_000

BITS = ("s0", "s1", "s2", "s3")
# Parity bits of a set whose links may differ in more n-grams than the short ones tell apart.
WIDE, WIDE_FROM, WIDE_TO = 2048, 64, 700

_U = np.uint64
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_BYTE[[9, 10, 11, 12, 13, 32]] = 0
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = _U(0x9E3779B97F4A7C15)
_POWERS = [np.multiply.accumulate(np.full(4096, _BASE))]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return h ^ (h >> _U(32))


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles, A-Z lower-cased.

    Fewer words than k: the whole sequence is the one shingle; no word: none.
    """
    b = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), np.uint8)
    solid = ~_SPACE[b]
    starts = np.flatnonzero(solid & np.r_[True, ~solid[:-1]])
    n = len(starts)
    if n == 0:
        return np.empty(0, np.uint64)
    size = np.diff(np.r_[starts, len(b)])
    if size.max() > len(_POWERS[0]):
        _POWERS[0] = np.multiply.accumulate(np.full(int(size.max()) * 2, _BASE))
    place = np.r_[np.zeros(starts[0], np.int64), np.arange(starts[0], len(b)) - np.repeat(starts, size)]
    words = _mix(np.add.reduceat(_BYTE[b] * _POWERS[0][place], starts))
    take = min(k, n)
    h = np.zeros(n - take + 1, np.uint64)
    for j in range(take):
        h = h * _U(0xA24BAED4963EE407) + words[j : n - take + 1 + j]
    return np.unique(_mix(h + _U(take)))


def _parts(frames: Iterator[pd.DataFrame], rows: int = 500) -> Iterator[pd.DataFrame]:
    """Few rows at a time, so a worker holds few sets."""
    for f in frames:
        for at in range(0, len(f), rows):
            yield f.iloc[at : at + rows].copy()


def _texts(frames: Iterator[pd.DataFrame], k: int):
    for f in frames:
        for row in f.itertuples(index=False):
            yield row, shingles(row.text if isinstance(row.text, str) else None, k)


def frequent_ngrams(docs: DataFrame, k: int, local: int = 4, keep: int = FREQUENT) -> np.ndarray:
    """The ``keep`` n-grams found most often, rarest first; counts are local ones of at least ``local``.

    They only set the order in which columns are taken, never what is compared.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0

        def flush():
            g, c = np.unique(np.concatenate(held), return_counts=True)
            return pd.DataFrame({"g": g[c >= local].view(np.int64), "c": c[c >= local]})

        for _, s in _texts(frames, k):
            held.append(s)
            n += len(s)
            if n > 1_500_000:
                yield flush()
                held, n = [], 0
        if held:
            yield flush()

    counted = docs.select("text").mapInPandas(run, "g long, c long").groupBy("g").agg(F.sum("c").alias("c"))
    top = counted.orderBy(F.desc("c"), "g").limit(keep).select("g").toArrow()
    return top.column("g").to_numpy()[::-1].astype(np.int64).view(np.uint64)


def incidence(docs: DataFrame, k: int, percent: int, last: np.ndarray) -> DataFrame:
    """``id, n, h1, h2, s0..s3, wide, prefix``: set size, a 128-bit fingerprint of the set, 256 parity bits, ``WIDE`` more of a large set, first columns.

    Columns are ordered by hash, those in ``last`` after all others. Two sets that link share a
    column among the first n - ceil(percent * n / 100) + 1 of each.
    """
    order = np.argsort(last)
    shared = docs.sparkSession.sparkContext.broadcast((last[order], order))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, rank = shared.value
        for f in _parts(frames):
            out = []
            for doc, text in zip(f["id"], f["text"]):
                s = shingles(text if isinstance(text, str) else None, k)
                n = len(s)
                p = n - -(-percent * n // 100) + 1 if n else 0
                at = np.searchsorted(known, s) if len(known) else np.zeros(n, np.int64)
                hot = known[np.minimum(at, len(known) - 1)] == s if len(known) else np.zeros(n, bool)
                first = s[~hot][:p]
                if len(first) < p:
                    tail = s[hot][np.argsort(rank[at[hot]])]
                    first = np.concatenate([first, tail[: p - len(first)]])
                odd = np.packbits((np.bincount((s & _U(255)).astype(np.int64), minlength=256) & 1).astype(np.uint8)).view(np.int64)
                wide = np.empty(0, np.int64)
                if 2 * n * (100 - percent) > WIDE_FROM * (100 + percent):
                    wide = np.packbits((np.bincount(((s >> _U(8)) & _U(WIDE - 1)).astype(np.int64), minlength=WIDE) & 1).astype(np.uint8)).view(np.int64)
                out.append((doc, n, int(s.view(np.int64).sum()), int(_mix(s + _U(77)).view(np.int64).sum()), *map(int, odd), wide, first.view(np.int64)))
            yield pd.DataFrame(out, columns=["id", "n", "h1", "h2", *BITS, "wide", "prefix"]).astype({"id": "Int64"})

    return docs.select("id", "text").mapInPandas(run, "id long, n long, h1 long, h2 long, s0 long, s1 long, s2 long, s3 long, wide array<long>, prefix array<long>")


def _full(rows: DataFrame, k: int, *carry: str) -> DataFrame:
    """``id``, the carried columns and the whole set of each row's text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in _parts(frames):
            f["s"] = [shingles(t if isinstance(t, str) else None, k).view(np.int64) for t in f["text"]]
            yield f.drop(columns="text")

    return rows.select("id", *carry, "text").mapInPandas(run, "id long, " + "".join(f"{c} long, " for c in carry) + "s array<long>")


def connected(links: DataFrame) -> DataFrame:
    """``node, root`` of all linked nodes: components by alternating large-star and small-star steps.

    It ends when only stars are left: each node has one link to a smaller one, which has none. Each step is written by
    itself, in few partitions: one plan of a whole round runs a stage of all shuffle partitions for each of its exchanges,
    and the driver keeps a record of every task and of every version of the plan.
    """
    c = F.col
    e = written(few_files(links.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).filter("u <> v").distinct()), "star")
    while True:
        ends = e.select(c("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("root")).unionByName(e.select(c("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("root")))
        if few_files(ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("root").alias("root"))).filter("up > 1 or (up > 0 and root > 0)").isEmpty():
            break
        both = e.unionByName(e.select(c("v").alias("u"), c("u").alias("v")))
        low = written(few_files(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))), "low")
        large = both.filter("v > u").join(low, "u").select(c("v").alias("u"), c("m").alias("v"))
        large = written(few_files(large.unionByName(low.filter("u <> m").select("u", c("m").alias("v"))).filter("u <> v").distinct()), "large")
        low2 = written(few_files(large.groupBy("u").agg(F.min("v").alias("m"))), "low")
        small_star = large.join(low2, "u").filter("v <> m").select(c("v").alias("u"), c("m").alias("v"))
        e = written(few_files(small_star.unionByName(low2.select("u", c("m").alias("v"))).filter("u <> v").distinct()), "star")
    return e.select(c("u").alias("node"), c("v").alias("root")).unionByName(e.select(c("v").alias("node"), c("v").alias("root")).distinct())


def _classes(label: DataFrame | None, links: DataFrame) -> DataFrame:
    """``id, cls`` of all linked nodes: classes so far, closed over new links.

    Links become links between classes, whose components are few and shallow: most of a group hangs
    on its pivot at once.
    """
    c = F.col
    if label is None:
        return written(few_files(connected(links).select(c("node").alias("id"), c("root").alias("cls")).distinct()), "labels")
    side = lambda name: label.select(c("id").alias(name), c("cls").alias("c" + name))
    over = links.join(side("x"), "x", "left").join(side("y"), "y", "left").select(F.coalesce("cx", "x").alias("x"), F.coalesce("cy", "y").alias("y"))
    root = connected(over)
    moved = label.join(root, c("cls") == c("node"), "left").select("id", F.coalesce("root", "cls").alias("cls"))
    new = root.select(c("node").alias("id"), c("root").alias("cls"))
    return written(few_files(moved.unionByName(new.join(label, "id", "left_anti"))), "labels")


def _room(percent: int, x=lambda f: F.col(f"{f}x"), y=lambda f: F.col(f"{f}y")):
    """Bounds on a joined pair (x, y) by sizes and by what both have left behind the column.

    Behind its first common column a pair shares no more than the shorter rest, so that column
    passes for every pair that links; later common columns need not pass again.
    """
    sizes = 100 * F.least(x("n"), y("n")) >= percent * F.greatest(x("n"), y("n"))
    return sizes & (F.least(x("n") - x("i"), y("n") - y("i")) * (100 + percent) >= percent * (x("n") + y("n")))


def _fit(percent: int, x=lambda f: F.col(f"{f}x"), y=lambda f: F.col(f"{f}y")):
    """``_room``, then parity bits, which differ in at most as many places as the sets have unshared n-grams."""
    apart = sum((F.bit_count(x(s).bitwiseXOR(y(s))) for s in BITS), F.lit(0))
    return _room(percent, x, y) & (apart * (100 + percent) <= (100 - percent) * (x("n") + y("n")))


def _references(cells: DataFrame, percent: int) -> DataFrame:
    """``id, r``: the reference row of a row, where one of its columns has a pivot within reach by size and parity bits.

    A column's pivot is the row that shares most columns with others, which for near copies of one text is
    the text itself or close to it; of several pivots a row takes the one with most. A reference is its own.
    The pivot also has to share a quarter of the row's first columns, which a passage in unlike texts is not.
    """
    c = F.col
    side = lambda name: cells.select("g", c("id").alias(name), c("n").alias(f"n{name}"), c("weight").alias(f"w{name}"), *[c(s).alias(f"{s}{name}") for s in BITS])
    pivot = side("x").groupBy("g").agg(F.max_by(F.struct("x", "nx", "wx", *[f"{s}x" for s in BITS]), F.struct("wx", "x")).alias("p")).select("g", "p.*")
    apart = sum((F.bit_count(c(f"{s}x").bitwiseXOR(c(f"{s}y"))) for s in BITS), F.lit(0))
    apart = F.greatest(apart, F.abs(c("nx") - c("ny")))
    near = apart * (100 + percent) <= REFERENCE_REACH * (100 - percent) * (c("nx") + c("ny"))
    shared = pivot.join(side("y"), "g").filter(near).groupBy("y", "x").agg(F.max("wx").alias("wx"), F.min("ny").alias("ny"), F.count(F.lit(1)).alias("m"))
    shared = shared.filter(4 * c("m") >= c("ny") - F.ceil(percent * c("ny") / 100) + 1)
    chosen = shared.groupBy("y").agg(F.max(F.struct("wx", "x")).alias("b")).select(c("y").alias("id"), c("b.x").alias("r")).filter("id <> r")
    chosen = written(few_files(chosen), "chosen")
    own = chosen.select(c("r").alias("id")).distinct()
    return written(few_files(chosen.join(own, "id", "left_anti").unionByName(own.withColumn("r", c("id")))), "references")


def _differences(refs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """``id, r, n, nd, d``: the n-grams in which a row and its reference differ, for rows within reach."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in _parts(frames):
            out = []
            for row in f.itertuples(index=False):
                s = shingles(row.text if isinstance(row.text, str) else None, k)
                ref = np.asarray(row.s, np.int64).view(np.uint64)
                d = np.setxor1d(s, ref, assume_unique=True)
                if len(s) and len(d) * (100 + percent) <= REFERENCE_REACH * (100 - percent) * (len(s) + len(ref)):
                    out.append((row.id, row.r, len(s), len(d), d.view(np.int64)))
            yield pd.DataFrame(out, columns=["id", "r", "n", "nd", "d"])

    texts = docs.select("id", "text")
    bases = _full(texts.join(small(refs.filter("id = r").select("id")), "id", "left_semi"), k).dropDuplicates(["id"]).withColumnRenamed("id", "r")
    rows = texts.join(small(refs), "id").join(bases, "r").select("id", "r", "text", "s")
    return written(rows.mapInPandas(run, "id long, r long, n long, nd long, d array<long>"), "differences")


def _near_one_reference(diff: DataFrame, percent: int) -> DataFrame:
    """Links (x, y) that hold the classes of all links between rows of one reference.

    The product of two rows x, y of reference r comes from their differences alone: they differ in
    nd(x) + nd(y) - 2 s n-grams, with s differing n-grams in common. So they link when w(x) + w(y) <= 2 q s
    for w = q nd - (100 - percent) n, q = 100 + percent. Pairs with w(x) + w(y) <= 0 need no common one: both
    then link with the row of least w, one star per reference. All others have a row outside the star and
    share a differing n-gram; they meet in the rarest of these, under a bound by place, and counts decide.
    """
    c, q = F.col, 100 + percent
    w = q * c("nd") - (100 - percent) * c("n")
    rows = diff.select("id", "r", "n", "nd", "d", w.alias("w"))
    base = rows.groupBy("r").agg(F.min(F.struct("w", "id")).alias("b"), F.max("n").alias("most")).select("r", c("b.w").alias("low"), c("b.id").alias("centre"), "most")
    base = written(few_files(base), "bases")
    rows = rows.join(small(base), "r").withColumn("out", c("w") + c("low") > 0)
    star = rows.filter(~c("out") & (c("id") != c("centre"))).select(c("id").alias("x"), c("centre").alias("y"))
    edge = written(few_files(rows.filter("out").groupBy("r").agg(F.min("w").alias("edge"))), "edges")
    # a row inside meets rows outside only; |d(x) - d(y)| <= difference of a link gives a second bound
    need = F.greatest(F.ceil((c("w") + F.when(c("out"), c("low")).otherwise(c("edge"))) / (2 * q)), c("nd") - F.floor((100 - percent) * (c("n") + c("most")) / q), F.lit(1))
    open_ = rows.join(small(edge), "r").withColumn("need", need).filter("nd >= need")
    cells = open_.select("r", "id", "n", "nd", "w", "out", "need", F.explode("d").alias("g"))
    cells = cells.withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("r", "g"))).filter("m > 1")
    lists = cells.groupBy("id", "r", "n", "nd", "w", "out", "need").agg(F.array_sort(F.collect_list(F.struct("m", "g"))).alias("o")).withColumn("k", F.size("o")).filter("k >= need")
    # differing n-grams that no other row has come first in the order and meet nothing
    heads = lists.select("r", "id", "nd", "w", "out", "k", F.posexplode(F.slice("o", F.lit(1), (c("k") - c("need") + 1).cast("int"))).alias("i", "e")).select("r", "id", "w", "out", "k", "i", c("e.g").alias("g"))
    heads = written(heads, "heads")
    side = lambda name: heads.select("r", "g", *[c(x).alias(f"{x}{name}") for x in ("id", "w", "out", "k", "i")])
    fit = (c("idx") > c("idy")) & (c("outx") | c("outy")) & (c("wx") + c("wy") <= 2 * q * F.least(c("kx") - c("ix"), c("ky") - c("iy")))
    pairs = written(side("x").join(side("y"), ["r", "g"]).filter(fit).select(c("idx").alias("x"), c("idy").alias("y"), c("wx").alias("wx"), c("wy").alias("wy")).distinct(), "near")
    d = diff.select("id", "d")
    both = pairs.join(d.select(c("id").alias("x"), c("d").alias("dx")), "x").join(d.select(c("id").alias("y"), c("d").alias("dy")), "y")
    linked = both.filter(c("wx") + c("wy") <= 2 * q * F.size(F.array_intersect("dx", "dy"))).select("x", "y")
    return written(star.unionByName(linked), "links")


def _small_products(cells: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y) of different references that share a column of at most ``COLUMN_SETS`` sets: the whole product of each.

    Both sides are one table under one projection, so one shuffle serves them.
    """
    rows = cells.filter(F.col("k") <= COLUMN_SETS).select("g", "id", "n", "i", "r", *BITS)
    a = rows.select("g", F.struct("id", "n", "i", "r", *BITS).alias("v")).alias("a")
    x, y = (lambda f: F.col(f"l.v.{f}")), (lambda f: F.col(f"r.v.{f}"))
    other = (x("id") > y("id")) & F.coalesce(x("r") != y("r"), F.lit(True))
    both = a.alias("l").join(a.alias("r"), (F.col("l.g") == F.col("r.g")) & other & _fit(percent, x, y))
    return both.select(x("id").alias("x"), y("id").alias("y"))


def _candidates(cols: DataFrame, percent: int, step: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (x, y) of different classes and references that this round compares, and the columns left for later.

    ``cols`` has (g, id, n, i: place in the row's order of columns, weight, parity bits, cls, blk). Rows of one
    ``blk`` are settled: they have one reference, or none and one class. Small products come whole: rows outside
    a column's largest block times all its rows. In a large one a pivot outside the largest block meets all rows
    of other blocks.
    """
    c = F.col
    per = cols.groupBy("g", "blk").agg(F.count(F.lit(1)).alias("m"))
    stat = per.groupBy("g").agg(F.sum("m").alias("m"), F.max_by("blk", F.struct("m", "blk")).alias("main"), ((F.sum("m") * F.sum("m") - F.sum(c("m") * c("m"))) / 2).alias("cross")).filter("cross > 0")
    stat = written(few_files(stat), "stat")
    whole = (c("cross") <= PAIRS_PER_SET * c("m")) if step < PIVOT_ROUNDS else F.lit(True)
    # sizes that can link lie in the same or in neighbouring steps of this scale
    scale = F.floor(F.log(c("n")) / math.log(100 / percent) + 1e-9).cast("int")
    t = written(cols.join(stat.withColumn("whole", whole).drop("cross", "m"), "g").withColumn("scale", scale), "columns")
    side = lambda name, *more: t.select("g", c("id").alias(name), c("n").alias(f"n{name}"), c("i").alias(f"i{name}"), *[c(s).alias(f"{s}{name}") for s in BITS], c("cls").alias(f"c{name}"), c("blk").alias(f"b{name}"), *more)
    central = F.max_by(F.struct("x", "nx", "ix", *[f"{s}x" for s in BITS], "cx", "bx"), F.struct(c("bx") != c("main"), "weight", "x"))
    b = side("y", "scale")
    fit = _fit(percent) & (c("cx") != c("cy")) & (c("bx") != c("by"))
    if step < PIVOT_ROUNDS:
        pivot = written(few_files(side("x", "whole", "main", "weight").filter(~c("whole")).groupBy("g").agg(central.alias("p")).select("g", "p.*")), "pivots")
        star = pivot.join(b, "g").filter(fit).select("x", "y")
    a = side("x", "main", "whole", "scale").filter(c("whole") & (c("bx") != c("main")))
    rest = a.withColumn("scale", F.explode(F.array(c("scale") - 1, c("scale"), c("scale") + 1))).join(b, ["g", "scale"]).filter(fit & ((c("by") == c("main")) | (c("x") < c("y"))))
    star = rest.select("x", "y") if step >= PIVOT_ROUNDS else star.unionByName(rest.select("x", "y"))
    return star, t.filter(~c("whole")).select("g", "id", "n", "i", "weight", "r", *BITS)


def _links(pairs: DataFrame, sets: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame | None:
    """Pairs whose whole sets link; None if no pair is left before. First the wide parity bits are compared, or the
    shared prefix columns counted where a set has no such bits or too many n-grams for them: what a pair can
    still share is bounded by its sizes, and pairs below the bound go before any whole
    set is built. Then rows of whole sets are multiplied with the row of their partner."""
    c = F.col
    counted = lambda df: (df, df.count())
    some = lambda df, n: F.broadcast(df) if n <= BROADCAST_ROWS else df
    pairs, n = counted(written(few_files(pairs.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).filter("x <> y").distinct()), "pairs"))
    if not n:
        return None
    told = (F.size("wide") > 0) & (2 * c("n") * (100 - percent) <= WIDE_TO * (100 + percent))
    first = sets.select("id", "n", "wide", F.when(~told, c("prefix")).alias("prefix"))
    px = first.join(some(pairs.withColumnRenamed("x", "id"), n), "id").select(c("id").alias("x"), "y", c("n").alias("nx"), c("wide").alias("wx"), c("prefix").alias("px"))
    py = first.join(some(pairs.select(c("y").alias("id")), n), "id", "left_semi").select(c("id").alias("y"), c("n").alias("ny"), c("wide").alias("wy"), c("prefix").alias("py"))
    bits = F.aggregate(F.zip_with("wx", "wy", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, b: a + b)
    apart = F.when((F.size("wx") > 0) & (F.size("wy") > 0), bits).otherwise(0)
    most = F.size(F.array_intersect("px", "py")) + F.greatest(c("nx") - F.size("px"), c("ny") - F.size("py"))
    most = F.when(c("px").isNotNull() & c("py").isNotNull(), most).otherwise(F.least("nx", "ny"))
    fit = (apart * (100 + percent) <= (100 - percent) * (c("nx") + c("ny"))) & (most * (100 + percent) >= percent * (c("nx") + c("ny")))
    near, n = counted(written(few_files(px.join(py, "y").filter(fit).select("x", "y").distinct()), "near"))
    if not n:
        return None
    texts = docs.select("id", "text")
    xs = _full(texts.join(some(near.withColumnRenamed("x", "id"), n), "id"), k, "y").withColumnsRenamed({"id": "x", "s": "sx"})
    ys = _full(texts.join(some(near.select(c("y").alias("id")), n), "id", "left_semi"), k).withColumnsRenamed({"id": "y", "s": "sy"})
    both = xs.join(ys, "y").withColumn("o", F.size(F.array_intersect("sx", "sy")))
    return written(both.filter(100 * c("o") >= percent * (F.size("sx") + F.size("sy") - c("o"))).select("x", "y").distinct(), "links")


def similarity_classes(df: DataFrame, ident: str = "doc_id", text: str = "text", k: int = 3, percent: int = 90) -> DataFrame:
    """One row per row of ``df``: ``ident``, ``n_shingles`` and ``component_id``.

    Two documents link when 100 * |A and B| >= percent * |A or B| over their distinct k-word
    shingles; ``component_id`` is the smallest id that links reach. No link between different
    sets is lost; links inside a class that are already implied aren't listed.

    The product is blocked by columns: equal sets collapse to one row, each set keeps its first
    columns under one order (those known to be frequent last), and only sets that share one are
    compared. Near copies of one text share nearly all columns, linked or not, so their block of the product
    is taken relative to a reference row: overlaps follow from the sizes of the differences, minus the counts
    of common differing n-grams, which are few. Across references, a pivot of a large column is compared
    with all rows, what links joins its class, and later rounds compare different classes only. Every
    step is a written table in the shared folder.

    Null, empty and wordless texts have 0 shingles and stay alone; fewer than k words make one
    shingle; repeated rows and equal texts link; an id that stands on several texts is one node, linked by any of them; a null id is returned alone with a null
    component; other columns are ignored; an empty table gives an empty table.
    """
    c = F.col
    docs = df.select(c(ident).cast("long").alias("id"), c(text).alias("text"))
    rows = written(incidence(docs, k, percent, frequent_ngrams(docs, k)), "incidence")
    sets = written(rows.filter("n > 0 and id is not null").groupBy("h1", "h2", "n").agg(F.min("id").alias("id"), *[F.first(x).alias(x) for x in (*BITS, "wide", "prefix")]), "sets")
    cells = sets.select(F.posexplode("prefix").alias("i", "g"), "id", "n")
    # one shuffle of the columns; rows stay that have a neighbour of a size that can link
    by = Window.partitionBy("g").orderBy("n", "id")
    many = cells.select("g", "id", "n", "i", F.lag("n").over(by).alias("less"), F.lead("n").over(by).alias("more"), F.count(F.lit(1)).over(Window.partitionBy("g")).alias("k"))
    many = written(many.filter((100 * c("less") >= percent * c("n")) | (100 * c("n") >= percent * c("more"))).select("g", "id", "n", "i", "k"), "many")
    # columns of few sets are multiplied out as they are; large ones may hold near copies of one text
    large = c("k") > 2 * PAIRS_PER_SET
    weight = F.sum(F.when(large, c("k")).otherwise(0)).over(Window.partitionBy("id")).alias("weight")
    cells = written(many.join(sets.select("id", *BITS), "id").select("g", "id", "n", "i", "k", weight, *BITS), "cells")
    label, found = None, None
    if cells.filter(large).isEmpty():
        cells = cells.withColumn("r", F.lit(None).cast("long"))
    else:
        # rows near one reference are settled by their differences from it; what is left are pairs across references
        text_of = F.struct("h1", "h2", "n")
        several = rows.filter("n > 0 and id is not null").groupBy("id").agg(F.min(text_of).alias("lo"), F.max(text_of).alias("hi")).filter("lo <> hi").select("id")
        several = written(few_files(several), "several")
        refs = _references(cells.filter(large).join(several, "id", "left_anti"), percent)
        diff = _differences(refs, docs, k, percent)
        found = _near_one_reference(diff, percent)
        settled = written(few_files(diff.select("id", "r").distinct()), "settled")
        cells = cells.join(small(settled), "id", "left")
    pairs, left, step = _small_products(cells, percent), cells.filter(c("k") > COLUMN_SETS).drop("k"), 1
    open_ = not left.isEmpty()
    while open_ or pairs is not None:
        if open_:
            known = left.withColumn("cls", c("id")) if label is None else left.join(label, "id", "left").withColumn("cls", F.coalesce("cls", "id"))
            more, left = _candidates(known.withColumn("blk", F.struct(c("r").isNull().alias("alone"), F.coalesce("r", "cls").alias("of"))), percent, step)
            pairs = more if pairs is None else pairs.unionByName(more)
        linked = _links(pairs, sets, docs, k, percent)
        linked = linked if found is None or linked is None else linked.unionByName(found)
        linked, found, pairs = found if linked is None else linked, None, None
        # pivots that link nothing would be the same again
        if linked is None or linked.isEmpty():
            step = max(step + 1, PIVOT_ROUNDS)
        else:
            label, step = _classes(label, linked), step + 1
        open_ = open_ and not left.isEmpty()
    if label is None:
        label = sets.select("id", c("id").alias("cls")).limit(0)
    comp = sets.select("h1", "h2", "n", "id").join(label, "id", "left").select("h1", "h2", "n", F.coalesce("cls", "id").alias("id"))
    comp = comp.withColumnRenamed("id", "component_id")
    out = rows.select("id", "n", "h1", "h2").join(comp, ["h1", "h2", "n"], "left")
    return out.select(c("id").alias(ident), c("n").alias("n_shingles"), F.when(c("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))
