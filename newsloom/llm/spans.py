"""Long passages that stand, character for character, in more than one record (problem 9).

Every text is cut into overlapping grams of ``GRAM`` characters; of each window of ``least``
characters the gram of smallest hash is kept as its anchor, so two records that share a stretch
of ``least`` characters share an anchor within it. Each partition of the texts counts its anchors
in a sparse sketch, cut by hash range; the sketches of a range are merged into one count-min
sketch whose load is the same whatever the number of texts, as there are more ranges for more of
them. A range tells each partition which of its cells were counted twice or more, in a file the
partition reads in the second pass: nothing is broadcast, no sketch passes the driver, and what is
moved is four bytes an anchor. Counts are never underestimated, so the second pass, which keeps only anchors
called repeated, loses none. Those are grouped exactly, together with a hash of the text around each:

* surroundings that stand in two records make their whole extent shared;
* an anchor in several records whose surroundings differ marks the edge of a shared stretch:
  there every window of ``least`` characters over the anchor is compared exactly.

The union of the shared stretches is the result, so no pairs of records are ever listed: a
passage that a third of all records hold costs its occurrences, not their pairs.

Defined results: null texts and texts under ``least`` characters have no passages; a passage
repeated only inside one record is none; equal texts under different ids share everything;
positions are Unicode code points.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from newsloom.session import own_dir, staged

#: Characters of a gram; a hash of GRAM characters stands for an anchor.
GRAM = 96
#: Cells of a sketch's row for each anchor it counts, and its rows: about one unique anchor in 20 passes.
SKETCH_LOAD = 4
SKETCH_ROWS = 2
#: Anchors of a hash range at least and at most, and ranges wanted between those: one task holds a range at a time.
RANGE_ANCHORS, RANGES = (1 << 16, 1 << 23), 4_096
#: Different surroundings of one anchor that one task compares at once.
HOT_KINDS = 20_000
#: Characters of texts that are hashed together.
CHUNK_CHARS = 2_000_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MULT = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (shift and multiply)."""
    x = (x ^ (x >> np.uint64(30))) * _MULT[0]
    x = (x ^ (x >> np.uint64(27))) * _MULT[1]
    return x ^ (x >> np.uint64(31))


def gram_hashes(values: np.ndarray, lengths: tuple[int, ...]) -> dict[int, np.ndarray]:
    """Polynomial hashes of all grams of the given lengths, by doubling; one array a length."""
    power: dict[int, np.ndarray] = {1: values}
    factor = {1: _BASE}
    size = 1
    while size * 2 <= max(lengths):
        a = power[size]
        if len(a) <= size:
            break
        power[size * 2] = a[:-size] * factor[size] + a[size:]
        factor[size * 2] = np.uint64(int(factor[size]) ** 2 & 0xFFFFFFFFFFFFFFFF)
        size *= 2
    out = {}
    for n in lengths:
        done, made = 0, None
        for bit in sorted((p for p in power if n & p), reverse=True):
            part = power[bit]
            if made is None:
                made = part
            else:
                made = made[: max(0, len(part) - done)] * factor[bit] + part[done : done + len(made)]
            done += bit
        out[n] = made[: max(0, len(values) - n + 1)] if made is not None and done == n else values[:0]
    return out


def _spread(a: np.ndarray, width: int, pick) -> np.ndarray:
    """Minimum or maximum over each window of ``width`` entries."""
    size, out = 1, a
    while size * 2 <= width:
        out = pick(out[:-size], out[size:])
        size *= 2
    return pick(out[: len(out) - (width - size)], out[width - size :]) if width > size else out


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' code points in one array, and the offset at which each starts."""
    raw = [t.encode("utf-32-le", "surrogatepass") for t in texts]
    return np.frombuffer(b"".join(raw), np.uint32), np.r_[0, np.cumsum([len(r) // 4 for r in raw])].astype(np.int64)


def anchors(texts: list[str], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``text, position, hash`` of the anchors of all texts, and the texts' code points and offsets."""
    points, starts = code_points(texts)
    width = least - GRAM + 1
    none = np.zeros(0, np.int64)
    if len(points) < least:
        return none, none, np.zeros(0, np.uint64), points, starts
    h = mix(gram_hashes(mix(points.astype(np.uint64) + np.uint64(1)), (GRAM,))[GRAM])
    low = _spread(h, width, np.minimum)
    owner = np.repeat(np.arange(len(texts)), np.diff(starts))
    n = len(points) - least + 1
    inside = owner[:n] == owner[least - 1 :]
    # A gram is an anchor if it is the minimum of some window that lies in one text.
    floor = np.zeros(len(h) + width - 1, np.uint64)
    floor[width - 1 : width - 1 + n] = np.where(inside, low[:n], np.uint64(0))
    top = _spread(floor, width, np.maximum)
    at = np.flatnonzero(h == top[: len(h)])
    at = at[owner[at] == owner[at + GRAM - 1]]
    return owner[at], at - starts[owner[at]], h[at], points, starts


def _cells(low: np.ndarray, bits: int) -> list[np.ndarray]:
    x = low.astype(np.uint64)
    return [(mix(x + np.uint64((r + 1) * int(_BASE) & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(64 - bits)).astype(np.int64) for r in range(SKETCH_ROWS)]


def _place(h: np.ndarray, ranges: int) -> np.ndarray:
    """Range and cell of an anchor in one number; anchors are small hashes, so they are mixed once more."""
    x = mix(h + _BASE)
    of = ((x >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
    return (of << np.uint64(32)) | (x & np.uint64(0xFFFFFFFF))


def _groups(texts: list, limit: int = CHUNK_CHARS) -> Iterator[slice]:
    lo = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= limit:
            yield slice(lo, i + 1)
            lo, size = i + 1, 0
    if lo < len(texts):
        yield slice(lo, len(texts))


def _sign(ids: np.ndarray, texts: list[str]) -> int:
    """What stands for the records of a partition, in any order."""
    size = np.fromiter(map(len, texts), np.uint64, len(texts))
    return int(mix(ids.astype(np.int64).view(np.uint64) ^ (size << np.uint64(40))).sum(dtype=np.uint64))


def sketch_shape(chars: int, least: int) -> tuple[int, int]:
    """Hash ranges for texts of so many characters, and the bits of a cell's number in each."""
    expected = int(chars / ((least - GRAM) / 2)) + 1
    each = int(np.clip(expected // RANGES, *RANGE_ANCHORS))
    return -(-expected // each), (each * SKETCH_LOAD - 1).bit_length()


def sketch_repeats(spark: SparkSession, rows: DataFrame, least: int, ranges: int, bits: int) -> str:
    """Writes, for each partition of ``rows``, the places of its anchors that were counted at least twice in all."""

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, sign = [], 0
        for batch in batches:
            texts = batch["text"].tolist()
            sign = (sign + _sign(batch["doc_id"].to_numpy(), texts)) & 0xFFFFFFFFFFFFFFFF
            for cut in _groups(texts):
                parts.append(_place(anchors(texts[cut], least)[2], ranges))
        place, count = np.unique(np.concatenate([np.zeros(0, np.uint64), *parts]), return_counts=True)
        of, low = (place >> np.uint64(32)).astype(np.int64), place.astype(np.uint32)
        edge = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, np.int64)
        ends = np.r_[edge[1:], len(of)]
        me = TaskContext.get().partitionId()
        head = pd.DataFrame({"of": [-1], "cells": [sign.to_bytes(8, "little")], "twice": [b""]})
        made = pd.DataFrame({"of": of[edge], "cells": [low[a:b].tobytes() for a, b in zip(edge, ends)], "twice": [np.packbits(count[a:b] > 1).tobytes() for a, b in zip(edge, ends)]})
        yield pd.concat([head, made]).assign(part=me)[["part", "of", "cells", "twice"]]

    def answer(sketches: list[tuple[int, bytes, bytes]], of: int) -> pd.DataFrame:
        """The merged sketch of one range, asked for the cells of each partition."""
        if of < 0:
            return pd.DataFrame({"of": of, "part": [p for p, _, _ in sketches], "cells": [c for _, c, _ in sketches]})
        low = [np.frombuffer(c, np.uint32) for _, c, _ in sketches]
        more = [np.unpackbits(np.frombuffer(t, np.uint8))[: len(x)] for (_, _, t), x in zip(sketches, low)]
        count = [np.zeros(1 << bits, np.uint8) for _ in range(SKETCH_ROWS)]
        for x, m in zip(low, more):
            for total, at in zip(count, _cells(x, bits)):
                # Cells of one partition that fall together count each.
                uniq, n = np.unique(at, return_counts=True)
                extra = np.bincount(np.searchsorted(uniq, at), m, len(uniq)).astype(np.int64)
                total[uniq] = np.minimum(total[uniq] + np.minimum(n + extra, 2), 2)
        kept = []
        for x in low:
            keep = np.ones(len(x), bool)
            for total, at in zip(count, _cells(x, bits)):
                keep &= total[at] > 1
            kept.append(x[keep].tobytes())
        return pd.DataFrame({"of": of, "part": [p for p, _, _ in sketches], "cells": kept})

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, now = [], None
        for pdf in batches:
            for part, of, cells, twice in zip(pdf["part"], pdf["of"], pdf["cells"], pdf["twice"]):
                if of != now and held:
                    yield answer(held, now)
                    held = []
                now = of
                held.append((part, cells, twice))
        if held:
            yield answer(held, now)

    parts = rows.mapInPandas(sketch, "part int, of long, cells binary, twice binary")
    merged = parts.repartition("of").sortWithinPartitions("of").mapInPandas(merge, "of long, part int, cells binary").where("of < 0 or length(cells) > 0")
    uri = f"{own_dir(spark)}/sketch-{uuid.uuid4().hex}"
    merged.repartition("part").write.partitionBy("part").parquet(uri)
    return uri


def told_repeats(uri: str, part: int) -> tuple[np.ndarray, int]:
    """The sorted places a partition was told to be repeated, and the sign of its records."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(uri.replace("s3a://", "s3://")) if "://" in uri else (fs.LocalFileSystem(), uri.removeprefix("file:"))
    found, sign = [np.zeros(0, np.uint64)], -1
    for f in where.get_file_info(fs.FileSelector(f"{path}/part={part}", allow_not_found=True)):
        if f.path.endswith(".parquet"):
            for batch in pq.ParquetFile(where.open_input_file(f.path)).iter_batches(columns=["of", "cells"]):
                for of, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if of < 0:
                        sign = int.from_bytes(cells, "little")
                    else:
                        found.append(np.frombuffer(cells, np.uint32).astype(np.uint64) | np.uint64(of << 32))
    return np.sort(np.concatenate(found)), sign


def _repeated(place: np.ndarray, told: np.ndarray) -> np.ndarray:
    if not len(told):
        return np.zeros(len(place), bool)
    return told[np.minimum(np.searchsorted(told, place), len(told) - 1)] == place


@contextmanager
def same_splits(spark: SparkSession) -> Iterator[None]:
    """Files are cut alike while this lasts, whatever executors come or go (else their cores have a say)."""
    key = "spark.sql.files.minPartitionNum"
    free = spark.conf.get(key, None) is None
    if free:
        spark.conf.set(key, str(max(1, spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        if free:
            spark.conf.unset(key)


def steady(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """``rows`` in partitions that are the same at each reading: a scan's are, others are written once."""
    plan = rows._jdf.queryExecution().executedPlan().toString()
    return rows if "FileScan" in plan and not any(x in plan for x in ("Exchange", "Join", "Union", "Coalesce", "Python", "InMemoryTableScan")) else staged(spark, rows, "texts")


def gram_range(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of any stretch: the binary parts of its length, each a gram of a power of two, chained in order."""
    out = (end - begin).astype(np.uint64) * _BASE
    at = begin.copy()
    sizes = [1 << k for k in range(int((end - begin).max(initial=1)).bit_length() - 1, -1, -1)]
    made = gram_hashes(values, tuple(sizes))
    for s in sizes:
        use = np.flatnonzero((end - at) >= s)
        if len(use) and len(made[s]):
            out[use] = mix(out[use] ^ made[s][at[use]])
            at[use] += s
    return out


def shared_spans(spark: SparkSession, df: DataFrame, id_col: str, text_col: str, least: int = 160) -> DataFrame:
    """``doc_id, start_pos, end_pos``: one row per maximal run of characters covered by stretches shared with another record."""
    if least < GRAM + 1:
        raise ValueError(f"least must be over {GRAM}")
    side = least - GRAM
    rows = df.where(F.col(id_col).isNotNull() & (F.length(text_col) >= least)).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = steady(spark, rows)
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    ranges, bits = sketch_shape(chars, least)

    def occurrences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (told, sign), met = told_repeats(uri, TaskContext.get().partitionId()), 0
        for pdf in batches:
            ids, texts = pdf["doc_id"].to_numpy(), pdf["text"].tolist()
            met = (met + _sign(ids, texts)) & 0xFFFFFFFFFFFFFFFF
            for cut in _groups(texts):
                own = ids[cut]
                owner, pos, h, points, starts = anchors(texts[cut], least)
                keep = _repeated(_place(h, ranges), told)
                owner, pos, h = owner[keep], pos[keep], h[keep]
                if not len(h):
                    continue
                size = np.diff(starts)[owner]
                begin, end = np.maximum(pos - side, 0), np.minimum(pos + least, size)
                around = gram_range(mix(points.astype(np.uint64) + np.uint64(1)), begin + starts[owner], end + starts[owner])
                around = mix(around ^ (pos - begin).astype(np.uint64))
                yield pd.DataFrame({"h": h.view(np.int64), "ctx": around.view(np.int64), "doc_id": own[owner], "pos": pos.astype(np.int32), "before": (pos - begin).astype(np.int16), "after": (end - pos).astype(np.int16)})
        if met != max(sign, 0):
            raise RuntimeError("the texts changed between two readings; pass a table that has been written")

    with same_splits(spark):
        uri = sketch_repeats(spark, rows, least, ranges, bits)
        found = staged(spark, rows.mapInPandas(occurrences, "h long, ctx long, doc_id long, pos int, before short, after short"), "occurrences")
    # One row for each anchor with the same surroundings; combined in the map tasks, whatever their number.
    kinds = staged(spark, found.groupBy("h", "ctx").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.min("pos").alias("pos")), "kinds")
    whole = kinds.where("lo < hi")
    inner = found.join(whole.select("h", "ctx"), ["h", "ctx"], "left_semi").select("doc_id", (F.col("pos") - F.col("before")).alias("a"), (F.col("pos") + F.col("after")).alias("b"))

    anchor = kinds.groupBy("h").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count(F.lit(1)).alias("kinds"), F.count_if(F.col("lo") == F.col("hi")).alias("single"))
    edges = anchor.where("lo < hi and kinds > 1 and single > 0").select("h")
    asked = kinds.join(edges, "h", "left_semi")
    # All occurrences of the surroundings that one record alone has; one of those that several have.
    alone = found.join(asked.where("lo = hi").select("h", "ctx"), ["h", "ctx"], "left_semi").select("h", "doc_id", "pos", F.lit(False).alias("many"))
    several = found.join(asked.where("lo < hi").select("h", "ctx", F.col("lo").alias("doc_id")), ["h", "ctx", "doc_id"]).groupBy("h", "ctx").agg(F.min(F.struct("doc_id", "pos")).alias("x")).select("h", "x.doc_id", "x.pos", F.lit(True).alias("many"))
    need = alone.unionByName(several).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "h", "many"))).alias("need"))
    need = need.select("doc_id", *[F.col(f"need.{c}").alias(c) for c in ("h", "pos", "many")])

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                size = pdf["pos"].map(len).to_numpy()
                h, pos, many = (np.concatenate(pdf[c].to_numpy()) for c in ("h", "pos", "many"))
                near = [text[max(0, p - side) : p + least] for text, at in zip(pdf["text"], pdf["pos"]) for p in at.tolist()]
                yield pd.DataFrame({"h": h.astype(np.int64), "doc_id": np.repeat(pdf["doc_id"].to_numpy(), size), "pos": pos.astype(np.int32), "many": many.astype(bool), "text": near})

    near = rows.join(need, "doc_id").select("doc_id", "text", "h", "pos", "many").mapInPandas(windows, "h long, doc_id long, pos int, many boolean, text string")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _whole_groups(batches):
            yield _edge_spans(pdf, least)

    # Anchors with very many different surroundings are compared window by window, spread over all tasks.
    hot = edges.join(anchor, "h").where(F.col("kinds") > HOT_KINDS).select("h")
    near = staged(spark, near, "edges")
    calm = near.join(hot, "h", "left_anti").repartition("h").sortWithinPartitions("h").mapInPandas(compare, "doc_id long, a int, b int")
    crowded = _crowded_spans(near.join(hot, "h", "left_semi"), least)
    return _union(inner.unionByName(calm).unionByName(crowded))


def _whole_groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches sorted by ``h``, cut so that no anchor is in two of them."""
    rest: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        last = pdf["h"].iloc[-1]
        cut = int(np.searchsorted((pdf["h"].to_numpy() == last).astype(int), 1))
        if cut:
            yield pd.concat([*rest, pdf.iloc[:cut]])
            rest = [pdf.iloc[cut:]]
        elif rest and rest[-1]["h"].iloc[-1] != last:
            yield pd.concat(rest)
            rest = [pdf]
        else:
            rest.append(pdf)
    if rest:
        yield pd.concat(rest)


def _window_table(pdf: pd.DataFrame, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and hash of every window of ``least`` characters over each row's anchor."""
    side = least - GRAM
    points, starts = code_points(pdf["text"].tolist())
    h = mix(gram_hashes(mix(points.astype(np.uint64) + np.uint64(1)), (least,))[least])
    before = np.minimum(pdf["pos"].to_numpy(), side)
    count = np.maximum(np.minimum(before + 1, np.diff(starts) - least + 1), 0)
    row = np.repeat(np.arange(len(pdf)), count)
    step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    return row, (pdf["pos"].to_numpy() - before)[row] + step, h[starts[row] + step]


def _edge_spans(pdf: pd.DataFrame, least: int) -> pd.DataFrame:
    """Windows over the anchors of single surroundings that stand in another record too."""
    row, start, h = _window_table(pdf, least)
    doc, many = pdf["doc_id"].to_numpy()[row], pdf["many"].to_numpy()[row]
    key = mix(h ^ mix(pdf["h"].to_numpy().view(np.uint64))[row])
    order = np.argsort(key, kind="stable")
    k = key[order]
    if not len(k):
        return pd.DataFrame({"doc_id": np.zeros(0, np.int64), "a": np.zeros(0, np.int32), "b": np.zeros(0, np.int32)})
    edge = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    group = np.repeat(np.arange(len(edge)), np.diff(np.r_[edge, len(k)]))
    d = doc[order]
    shared = (np.minimum.reduceat(d, edge) < np.maximum.reduceat(d, edge)) | np.maximum.reduceat(many[order], edge)
    hit = order[shared[group] & ~many[order]]
    hit.sort()
    r, s = row[hit], start[hit]
    if not len(r):
        return pd.DataFrame({"doc_id": np.zeros(0, np.int64), "a": np.zeros(0, np.int32), "b": np.zeros(0, np.int32)})
    new = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (s[1:] != s[:-1] + 1)])
    end = np.r_[new[1:], len(r)] - 1
    return pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy()[r[new]], "a": s[new].astype(np.int32), "b": (s[end] + least).astype(np.int32)})


def _crowded_spans(near: DataFrame, least: int) -> DataFrame:
    """The same for hot anchors, as one row a window grouped by its hash and its anchor's."""

    def table(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                row, start, h = _window_table(pdf, least)
                yield pd.DataFrame({"h": pdf["h"].to_numpy()[row], "w": h.view(np.int64), "doc_id": pdf["doc_id"].to_numpy()[row], "many": pdf["many"].to_numpy()[row], "a": start.astype(np.int32)})

    windows = near.mapInPandas(table, "h long, w long, doc_id long, many boolean, a int")
    shared = windows.groupBy("h", "w").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.max("many").alias("any")).where("lo < hi or any").select("h", "w")
    return windows.where("not many").join(shared, ["h", "w"], "left_semi").select("doc_id", "a", (F.col("a") + least).cast("int").alias("b"))


def _union(spans: DataFrame) -> DataFrame:
    """Maximal runs of overlapping or touching spans of each record."""
    order = W.partitionBy("doc_id").orderBy("a", "b")
    reach = F.max("b").over(order.rowsBetween(W.unboundedPreceding, -1))
    parts = spans.distinct().withColumn("new", (F.coalesce(reach, F.lit(-1)) < F.col("a")).cast("int"))
    runs = parts.withColumn("run", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return runs.groupBy("doc_id", "run").agg(F.min("a").cast("int").alias("start_pos"), F.max("b").cast("int").alias("end_pos")).drop("run")


def shared_report(spans: DataFrame, df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, n_spans, shared_chars, shared_part`` of every record, 0 where nothing is shared."""
    total = spans.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end_pos") - F.col("start_pos")).alias("c"))
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.length(text_col), F.lit(0)).alias("len"))
    shared = F.coalesce("c", F.lit(0))
    return rows.join(total, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("n_spans"), shared.alias("shared_chars"), F.when(F.col("len") > 0, shared / F.col("len")).otherwise(0.0).alias("shared_part"))
