"""Most similar vectors for every vector, by randomly rotated one-bit codes (problem 1).

Vectors are assigned to the cells of a coarse index. Inside a cell every vector's residual to
the cell's centroid is rotated at random and kept as one sign bit a dimension, packed into
words, with two correction scalars. The inner product of a query with a member is estimated
from the packed bits (the query being cut into 4-bit planes), and the error bound of that
estimate decides which members are compared exactly.

Scale: the first cells are fitted on at most ``FIT_ROWS`` vectors but hold every row. A cell of more
than ``BLOCK_ROWS`` members is cut again around pivots drawn from its own members, and so are the
cells that come of it, until none is hot; a level brings at most ``PIVOT_ROWS`` pivots to the driver.
Queries of a cut cell go to its nearest pivots, at most ``MOST_CELLS`` cells in all, so the work is
linear in the rows even if a third of them lie together. Cells that many queries come to - small ones
beside a dense region - have their queries parted and their few members copied to each part. Inside a
task, tiles of ``TILE`` queries are estimated at once, and compared exactly only where the error bound
reaches the k-th best similarity found so far. Vectors that are equal are one representative; each row
of the group is given partners from the group's smallest ids. Each group returns at most ``k`` partners
a vector, so what leaves it is linear in its rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from newsloom.session import staged

#: Most vectors the first cells are fitted on (drawn by a hash of the id), and how many stand behind one cell.
FIT_ROWS, ROWS_A_CELL = 16_384, 8
#: Members wanted in a cell; sample queries and the part of their partners that the number of probes is set by.
CELL_ROWS, TRIAL_QUERIES, TRIAL_RECALL = 512, 2_048, 0.99
#: Most members of a cell, and most queries that meet them in one task.
BLOCK_ROWS, QUERY_ROWS = 4_096, 8_192
#: Most pivots of one level (256 bytes each), and the most cells a vector is looked for in.
PIVOT_ROWS, MOST_CELLS = 32_768, 48
#: Queries that are estimated at once, and pairs that are compared exactly at once.
TILE, PAIRS = 256, 65_536
#: Width of the error bound in standard deviations of the estimate.
EPSILON = 2.5
QUERY_BITS = 4


def parse_vectors(df: DataFrame, id_col: str, json_col: str, dim: int) -> DataFrame:
    """``id, vec`` (unit length, float32 bytes) of the rows with a usable vector.

    Usable: a JSON list of exactly ``dim`` finite numbers, not all zero; anything else gives no row.
    """

    v = F.from_json(F.when(F.col(json_col).rlike(r"^\s*\[[-+0-9eE.,\s]*\]\s*$"), F.col(json_col)), "array<double>")
    rows = df.where(F.col(id_col).isNotNull() & F.col(json_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    rows = rows.where((F.size("v") == dim) & ~F.exists("v", lambda x: x.isNull()))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            top = np.abs(a).max(axis=1, initial=0)
            use = np.flatnonzero(np.isfinite(top) & (top > 0))
            a = a[use] / top[use, None]
            a = (a / np.sqrt(np.einsum("ij,ij->i", a, a))[:, None]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(use)), pa.array([x.tobytes() for x in a], pa.binary())], ["id", "vec"])

    return rows.mapInArrow(pack, "id long, vec binary")


def fit_cells(sample: np.ndarray, n_cells: int, seed: int, rounds: int = 4) -> np.ndarray:
    """Centroids of a spherical k-means on the sample."""
    rng = np.random.default_rng(seed)
    n_cells = min(n_cells, len(sample))
    centroids = sample[rng.choice(len(sample), n_cells, replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([(block @ centroids.T).argmax(axis=1) for block in np.array_split(sample, max(1, len(sample) // 4096))])
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, sample)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(length > 0, sums / np.maximum(length, 1e-12), centroids)
    return centroids.astype(np.float32)


def rotation(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


class OneBitCodes:
    """Packed codes of a block's members around a centroid, with the scalars that correct the estimate."""

    def __init__(self, members: np.ndarray, centroid: np.ndarray, turn: np.ndarray):
        self.centroid, self.turn, self.dim = centroid, turn, members.shape[1]
        residual = members - centroid
        self.length = np.linalg.norm(residual, axis=1)
        turned = (residual / np.maximum(self.length, 1e-9)[:, None]) @ turn
        self.words = np.packbits(turned > 0, axis=1)
        pad = -self.words.shape[1] % 8
        self.words = np.ascontiguousarray(np.pad(self.words, ((0, 0), (0, pad)))).view(np.uint64)
        self.ones = np.bitwise_count(self.words).sum(axis=1).astype(np.float32)
        # <code, residual direction>: how well the code stands for the residual
        self.fit = np.maximum(np.abs(turned).sum(axis=1) / math.sqrt(self.dim), 1e-3).astype(np.float32)
        self.at_centroid = members @ centroid

    def estimate(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimated inner products of queries and members, and the bound of their error."""
        residual = queries - self.centroid
        length = np.linalg.norm(residual, axis=1)
        turned = (residual / np.maximum(length, 1e-9)[:, None]) @ self.turn
        low = turned.min(axis=1, keepdims=True)
        step = np.maximum((turned.max(axis=1, keepdims=True) - low) / (2**QUERY_BITS - 1), 1e-9)
        levels = np.rint((turned - low) / step).astype(np.uint8)
        total = levels.sum(axis=1).astype(np.float32)
        both = np.zeros((len(queries), len(self.words)), np.float32)
        for b in range(QUERY_BITS):
            plane = np.packbits((levels >> b) & 1, axis=1)
            plane = np.ascontiguousarray(np.pad(plane, ((0, 0), (0, -plane.shape[1] % 8)))).view(np.uint64)
            for w in range(plane.shape[1]):
                both += np.float32(1 << b) * np.bitwise_count(plane[:, w, None] & self.words[None, :, w])
        root = math.sqrt(self.dim)
        # <code, turned query> with code = (2 bits - 1) / sqrt(dim) and turned = low + step * level
        code_query = (2 * step * both + 2 * low * self.ones[None, :] - step * total[:, None] - self.dim * low) / root
        scale = length[:, None] * self.length[None, :]
        base = self.at_centroid[None, :] + (queries @ self.centroid)[:, None] - float(self.centroid @ self.centroid)
        spread = np.sqrt(np.maximum(1 - self.fit**2, 0)) / self.fit / math.sqrt(self.dim - 1)
        return base + scale * code_query / self.fit[None, :], EPSILON * scale * spread[None, :]


def _search(members: np.ndarray, queries: np.ndarray, turn: np.ndarray, floor: float, k: int, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (query row, member row, exact similarity) of at least ``floor`` that may be among the query's ``k`` best.

    ``own``: the member row that a query itself is, or -1; no row finds itself.
    """
    codes = OneBitCodes(members, members.mean(axis=0), turn)
    exact = members.astype(np.float64)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    first = min(4 * k, len(members))
    for lo in range(0, len(queries), TILE):
        q = queries[lo : lo + TILE]
        value, error = codes.estimate(q)
        me = own[lo : lo + TILE]
        value[np.flatnonzero(me >= 0), me[me >= 0]] = -np.inf
        q = q.astype(np.float64)
        bar = np.full(len(q), floor)
        if len(members) > first:
            # The k-th best of those that look best is what the others must be able to reach.
            top = np.argpartition(-value, first - 1, axis=1)[:, :first]
            s = np.where(np.isfinite(np.take_along_axis(value, top, axis=1)), np.einsum("qd,qkd->qk", q, exact[top]), -np.inf)
            bar = np.maximum(bar, np.partition(s, first - k, axis=1)[:, first - k] - 1e-12)
        i, j = np.nonzero(value + error >= bar[:, None])
        for at in range(0, len(i), PAIRS):
            x, y = i[at : at + PAIRS], j[at : at + PAIRS]
            s = np.einsum("ij,ij->i", q[x], exact[y])
            keep = s >= bar[x]
            found.append((x[keep] + lo, y[keep], s[keep]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _matrix(column: pd.Series, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float32).reshape(-1, dim)


def _nearest(v: np.ndarray, centroids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and similarities of the nearest centroids of each vector, the nearest first."""
    most = min(most, len(centroids))
    places, sims = [], []
    for lo in range(0, len(v), 2048):
        score = v[lo : lo + 2048] @ centroids.T
        near = np.argpartition(-score, most - 1, axis=1)[:, :most]
        s = np.take_along_axis(score, near, axis=1)
        order = np.argsort(-s, axis=1, kind="stable")
        places.append(np.take_along_axis(near, order, axis=1))
        sims.append(np.take_along_axis(s, order, axis=1))
    return np.concatenate(places), np.concatenate(sims)


_CELLS = "rep long, home int, near array<int>, sims array<float>, vec binary"


def probes_needed(sample: np.ndarray, centroids: np.ndarray, k: int, floor: float) -> int:
    """In how many nearest cells sample vectors must be looked for to find nearly all their partners in the sample."""
    home = _nearest(sample, centroids, 1)[0][:, 0]
    ranks = [np.zeros(0, np.int64)]
    for lo in range(0, min(len(sample), TRIAL_QUERIES), TILE):
        q = sample[lo : lo + TILE]
        s = q @ sample.T
        s[np.arange(len(q)), lo + np.arange(len(q))] = -1
        top = np.argpartition(-s, min(k, len(sample) - 1) - 1, axis=1)[:, :k] if len(sample) > k else np.tile(np.arange(len(sample)), (len(q), 1))
        i, j = np.nonzero(np.take_along_axis(s, top, axis=1) >= floor)
        place = np.argsort(np.argsort(-(q @ centroids.T), axis=1, kind="stable"), axis=1, kind="stable")
        ranks.append(place[i, home[top[i, j]]])
    ranks = np.concatenate(ranks)
    return int(np.quantile(ranks, TRIAL_RECALL, method="higher")) + 1 if len(ranks) else 1


def first_cells(spark: SparkSession, vectors: DataFrame, distinct: DataFrame, n: int, dim: int, k: int, floor: float, probes: int, seed: int) -> tuple[DataFrame, int]:
    """Every distinct vector with its home cell and the cells it is looked for in; and the number of cells.

    Vectors are looked for in at least ``probes`` cells, in more where the sample shows that its partners lie further apart.
    """
    share = min(1.0, 1.1 * FIT_ROWS / n)
    picked = vectors.where(F.abs(F.xxhash64("id", F.lit(seed)) % 1_000_000) < int(share * 1_000_000)).select("vec").limit(FIT_ROWS).toPandas()
    sample = _matrix(picked["vec"], dim) if len(picked) else np.eye(1, dim, dtype=np.float32)
    n_cells = max(1, min(n // CELL_ROWS, FIT_ROWS // ROWS_A_CELL))
    while True:
        centroids = fit_cells(sample, n_cells, seed)
        needed = probes_needed(sample, centroids, k, floor)
        # Where nothing is near anything in particular, fewer and larger cells are searched with less to move.
        if needed <= 16 or 4 * n // n_cells > BLOCK_ROWS:
            break
        n_cells = max(1, n_cells // 4)
    probes = min(max(probes, needed), MOST_CELLS)
    held = spark.sparkContext.broadcast(centroids)  # at most FIT_ROWS / ROWS_A_CELL rows

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                near, sims = _nearest(_matrix(pdf["vec"], dim), held.value, probes)
                yield pd.DataFrame({"rep": pdf["rep"], "home": near[:, 0].astype(np.int32), "near": list(near.astype(np.int32)), "sims": list(sims), "vec": pdf["vec"]})

    return staged(spark, distinct.select("rep", "vec").mapInPandas(assign, _CELLS), "cells"), len(centroids)


def split_hot_cells(spark: SparkSession, cells: DataFrame, n_cells: int, dim: int, seed: int) -> DataFrame:
    """The same with every cell of more than ``BLOCK_ROWS`` members cut around pivots of its own, level by level."""
    level = 0
    while True:
        hot = {r["home"]: r["count"] for r in cells.groupBy("home").count().where(F.col("count") > BLOCK_ROWS).collect()}  # fewer than there are cells
        if not hot:
            return cells
        level += 1
        want = {c: max(8, -(-2 * m // BLOCK_ROWS)) for c, m in hot.items()}
        scale = min(1.0, PIVOT_ROWS / sum(want.values()))
        rates = spark.createDataFrame([(c, 1.5 * scale * want[c] / m) for c, m in hot.items()], "home int, rate double")
        drawn = F.pmod(F.xxhash64("rep", F.lit(seed + level)), F.lit(1 << 40)) < F.col("rate") * (1 << 40)
        picked = cells.join(rates, "home").where(drawn).select("home", "vec").limit(2 * PIVOT_ROWS).toPandas()
        pivots: dict[int, tuple[int, np.ndarray]] = {}
        for c, rows in picked.groupby("home"):
            if len(rows) > 1:
                pivots[int(c)] = (n_cells, _matrix(rows["vec"], dim))
                n_cells += len(rows)
        held = spark.sparkContext.broadcast(pivots)

        def move(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if not len(pdf):
                    continue
                v, home = _matrix(pdf["vec"], dim), pdf["home"].to_numpy().copy()
                size = pdf["near"].map(len).to_numpy()
                row, cell, sim = np.repeat(np.arange(len(pdf)), size), np.concatenate(pdf["near"].to_numpy()), np.concatenate(pdf["sims"].to_numpy())
                gone, more = np.zeros(len(row), bool), []
                for c in np.intersect1d(cell, np.fromiter(held.value, np.int64)):
                    base, around = held.value[int(c)]
                    at = np.flatnonzero(cell == c)
                    near, sims = _nearest(v[row[at]], around, MOST_CELLS)
                    gone[at] = True
                    mine = home[row[at]] == c
                    home[row[at][mine]] = base + near[mine, 0]
                    more.append((np.repeat(row[at], near.shape[1]), (base + near).ravel(), sims.ravel()))
                row, cell, sim = (np.concatenate([x[~gone], *[m[i] for m in more]]) for i, x in enumerate((row, cell, sim)))
                order = np.lexsort((cell, -sim, row))
                row, cell, sim = row[order], cell[order], sim[order]
                start = np.searchsorted(row, np.arange(len(pdf)))
                keep = np.arange(len(row)) - start[row] < MOST_CELLS
                row, cell, sim = row[keep], cell[keep].astype(np.int32), sim[keep].astype(np.float32)
                edge = np.searchsorted(row, np.arange(1, len(pdf)))
                yield pd.DataFrame({"rep": pdf["rep"], "home": home.astype(np.int32), "near": np.split(cell, edge), "sims": np.split(sim, edge), "vec": pdf["vec"]})

        cells = staged(spark, cells.mapInPandas(move, _CELLS), "cells")


def most_similar(spark: SparkSession, df: DataFrame, id_col: str, json_col: str, k: int = 5, floor: float = 0.85, dim: int = 64, probes: int = 4, seed: int = 7) -> DataFrame:
    """``id, other, similarity, rank``: the ``k`` most similar other rows of each row, of at least ``floor``.

    Ties are broken by the smaller id. Rows without a usable vector are neither queries nor partners;
    an empty table gives an empty result; equal vectors are partners of similarity 1.
    """
    found = "id long, other long, similarity double, rank int"
    vectors = staged(spark, parse_vectors(df, id_col, json_col, dim), "vectors")
    groups = (
        vectors.groupBy(F.xxhash64("vec").alias("h"), "vec")
        .agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("size"))
        .select("rep", "size", "vec")
    )
    n = vectors.count()
    if n == 0:
        return spark.createDataFrame([], found)
    # Only one row a group of equal vectors takes part in the search; its vector is stored once, not once a cell.
    cells, n_cells = first_cells(spark, vectors, groups, n, dim, k, floor, probes, seed)
    cells = split_hot_cells(spark, cells, n_cells, dim, seed)
    asked = cells.select("rep", "vec", "home", F.explode(F.array_union("near", F.array("home"))).alias("cell"))
    # Of a cell that many queries come to, each goes to one part and the members to all.
    busy = cells.select(F.explode(F.array_union("near", F.array("home"))).alias("cell")).groupBy("cell").count().where(F.col("count") > QUERY_ROWS)
    busy = busy.select("cell", F.ceil(F.col("count") / QUERY_ROWS).cast("int").alias("parts"))
    asked = asked.join(busy, "cell", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("member", F.col("cell") == F.col("home"))
    own = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
    asked = asked.withColumn("own", own).withColumn("part", F.explode(F.when(F.col("member"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("own"))))
    placed = asked.select("cell", "part", "rep", "member", (F.col("part") == F.col("own")).alias("query"), "vec")

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        v = _matrix(pdf["vec"], dim)
        rep, member, query = pdf["rep"].to_numpy(), np.flatnonzero(pdf["member"]), np.flatnonzero(pdf["query"])
        empty = pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64), "s": np.zeros(0)})
        if not len(member) or not len(query):
            return empty
        place = np.full(len(pdf), -1)
        place[member] = np.arange(len(member))
        i, j, s = _search(v[member], v[query], rotation(dim, seed), floor, k, place[query])
        a, b = rep[query[i]], rep[member[j]]
        # Either finds the other: the k best of each, seen from both sides.
        a, b, s = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([s, s])
        if not len(a):
            return empty
        order = np.lexsort((b, -s, a))
        a, b, s = a[order], b[order], s[order]
        fresh = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
        a, b, s = a[fresh], b[fresh], s[fresh]
        start = np.r_[0, np.flatnonzero(a[1:] != a[:-1]) + 1]
        place = np.arange(len(a)) - np.repeat(start, np.diff(np.r_[start, len(a)]))
        keep = place < k
        return pd.DataFrame({"a": a[keep], "b": b[keep], "s": s[keep]})

    links = placed.groupBy("cell", "part").applyInPandas(search, "a long, b long, s double").groupBy("a", "b").agg(F.max("s").alias("s"))
    best = links.withColumn("r", F.row_number().over(W.partitionBy("a").orderBy(F.desc("s"), "b"))).where(F.col("r") <= k).select("a", "b", "s")

    # Groups of equal vectors: the k + 1 smallest ids are all that anyone can take from them.
    reps = vectors.join(groups.where("size > 1").select("rep", F.col("vec").alias("gv")), F.col("vec") == F.col("gv")).select("rep", "id")
    firsts = _smallest(reps, k + 1)
    inside = reps.join(firsts, "rep").select("id", F.explode("ids").alias("other")).where("id <> other").withColumn("s", F.lit(1.0))
    taken = best.join(firsts.withColumnRenamed("rep", "b"), "b", "left").select("a", F.explode(F.coalesce("ids", F.array("b"))).alias("other"), "s")
    across = taken.join(reps.withColumnRenamed("rep", "a"), "a", "left").select(F.coalesce("id", "a").alias("id"), "other", "s")
    both = inside.unionByName(across)
    rank = F.row_number().over(W.partitionBy("id").orderBy(F.desc("s"), "other"))
    return both.withColumn("rank", rank).where(F.col("rank") <= k).select("id", "other", F.col("s").alias("similarity"), "rank")


def _smallest(reps: DataFrame, k: int) -> DataFrame:
    """The ``k`` smallest ids of each group, combined map-side so that a hot group never lies in one task."""
    salted = reps.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    near = salted.withColumn("_r", F.row_number().over(W.partitionBy("rep", "_salt").orderBy("id"))).where(F.col("_r") <= k)
    last = near.withColumn("_r", F.row_number().over(W.partitionBy("rep").orderBy("id"))).where(F.col("_r") <= k)
    return last.groupBy("rep").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def neighbour_pairs(neighbours: DataFrame) -> DataFrame:
    """``chunk_a, chunk_b``: each unordered pair of which at least one takes the other, once."""
    return neighbours.select(F.least("id", "other").alias("chunk_a"), F.greatest("id", "other").alias("chunk_b")).distinct()
