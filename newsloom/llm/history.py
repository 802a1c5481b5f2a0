"""New batches against everything accepted before, without going through it again (problem 5).

What identifies a record - the digest of its content and the address it lies at - is cut at the
landmarks of a rolling hash, and each chunk is hashed by itself, so an edit alters only the chunks
around it. A persistent table holds every accepted payload with its chunks, their bytes and the
document it belongs to. A batch looks its own chunks up there: the bytes two payloads share, over
the bytes of the longer, are their coverage, and the coverage decides what is known. Chunks of new
payloads are appended. Records, texts and links of the history are never read again.

Every payload is filed under its rarest chunks - as many as hold more than one part in ``1 - threshold``
of its bytes, so a payload of enough coverage must hold one of them - and a batch asks with all its
chunks. A chunk that a third of all payloads have files only those that have nothing rarer.

The table is a folder of parts and a log of versions. A version names all its parts and is written
last, by creating a file that may not exist: a batch that is cut off leaves no trace, two writers of
one version can't both succeed, and a history that is opened again is the one that was left.
``compact`` makes one part of many.

Linking is by digest, or by address where a record has no digest: records without one belong to
the document of the first digest seen at their address, so different digests at one address stay
different documents and every document is a star, which needs no iteration.

Defined results: a digest that isn't 64 hexadecimal digits, is one digit repeated, or is that of
empty content, counts as none; records with neither digest nor address are new; null batch numbers come last; repeated
record numbers are one record; an empty batch changes nothing. Results of earlier batches stay
as they were given out.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import re
import uuid
from collections import Counter
from collections.abc import Sequence
from functools import reduce
from urllib.parse import parse_qsl, quote, unquote, urlsplit

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.llm.pieces import landmark_hash
from newsloom.session import shared_dir, staged

#: Fixed value: SHA-256 of no bytes at all.
EMPTY_DIGEST = hashlib.sha256(b"").hexdigest()
#: Query parameters that say where a click came from, not which file is meant.
TRACKING = re.compile(r"(?i)^(utm_\w+|fbclid|gclid|dclid|msclkid|mc_cid|mc_eid|igshid|ref_src|_hs\w+)$")
#: Records of a batch whose keys (some 200 bytes each) may be broadcast; a larger batch is shuffled against the table.
FEW = 200_000
#: Least bytes of a chunk, and one position in how many is a landmark.
LEAST_BYTES, LANDMARK_EVERY = 32, 48


def digest_key(c: Column) -> Column:
    """The digest in plain form, null if it says nothing about the content."""
    bare = F.regexp_replace(F.lower(F.regexp_replace(c, r"[\s ]+", "")), r"^(sha-?256[:=])", "")
    blank = bare.rlike(r"^(.)\1*$")  # one digit over and over is a placeholder
    return F.when(bare.rlike("^[0-9a-f]{64}$") & (bare != EMPTY_DIGEST) & ~blank, bare)


def address_key(url: str | None) -> str | None:
    """The file an address leads to: host without ``www.``, path resolved and decoded, parameters in order."""
    if not url or not url.strip():
        return None
    try:
        parts = urlsplit(url.strip() if "//" in url else "//" + url.strip())
        host = (parts.hostname or "").rstrip(".")
        port = parts.port
    except ValueError:
        return url.strip()
    if host.startswith("www."):
        host = host[4:]
    path = posixpath.normpath("/" + unquote(parts.path).lstrip("/")) if parts.path else "/"
    query = sorted((k, v) for k, v in parse_qsl(parts.query, keep_blank_values=True) if not TRACKING.match(k))
    return host + (f":{port}" if port not in (None, 80, 443) else "") + quote(path) + ("?" + "&".join(f"{quote(k)}={quote(v)}" for k, v in query) if query else "")


def chunk_payload(payload: str) -> list[tuple[bytes, int]]:
    """Hash and bytes of each chunk of a payload; the second of two equal chunks is another than the first."""
    raw = payload.encode("utf-8", "surrogatepass")
    marks = np.flatnonzero(landmark_hash(np.frombuffer(raw, np.uint8)) % np.uint64(LANDMARK_EVERY) == 0) + 1
    ends, at = [], 0
    for m in [*marks.tolist(), len(raw)]:
        if m - at >= LEAST_BYTES and len(raw) - m >= LEAST_BYTES or m == len(raw):
            ends.append(m)
            at = m
    out, met, at = [], Counter(), 0
    for e in ends:
        chunk, at = raw[at:e], e
        out.append((hashlib.blake2b(chunk, digest_size=16, salt=met[chunk].to_bytes(8, "big")).digest(), len(chunk)))
        met[chunk] += 1
    return out


_KEY = "struct<key: binary, chunks: array<struct<chunk: binary, bytes: int>>>"


def _payload_frame(payloads: pd.Series) -> pd.DataFrame:
    """The hash that stands for a whole payload, and its chunks."""
    cut = [chunk_payload(p) if p else None for p in payloads]
    keys = [hashlib.blake2b(p.encode("utf-8", "surrogatepass"), digest_size=16).digest() if p else None for p in payloads]
    return pd.DataFrame({"key": keys, "chunks": [[{"chunk": h, "bytes": n} for h, n in c] if c else None for c in cut]})


def _address_frame(urls: pd.Series) -> pd.DataFrame:
    return _payload_frame(urls.map(address_key, na_action="ignore"))


def _payload_key(c: Column | str) -> Column:
    return F.pandas_udf(_payload_frame, _KEY)(c)


def total_bytes(chunks: Column | str) -> Column:
    return F.aggregate(chunks, F.lit(0).cast("long"), lambda n, c: n + c["bytes"])


def rarest_chunks(payloads: DataFrame, threshold: float) -> DataFrame:
    """Adds ``filed``: the chunks each payload (``key, chunks``) is found by, rarest first among these payloads.

    Of equally rare chunks the later ones come first. Bytes beyond ``1 - threshold`` of all are enough.
    """
    each = payloads.select("key", F.posexplode("chunks").alias("at", "c")).select("key", "at", "c.chunk", "c.bytes")
    rarity = each.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"))
    own = W.partitionBy("key")
    before = F.coalesce(F.sum("bytes").over(own.orderBy("n", F.desc("at")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = each.join(rarity, "chunk").select("key", "chunk", before.alias("before"), F.sum("bytes").over(own).alias("total"))
    filed = ranked.where(F.col("before") <= (1 - threshold) * F.col("total") + 1e-6).groupBy("key").agg(F.collect_list("chunk").alias("filed"))
    return payloads.join(filed, "key", "left")


class History:
    """The persistent chunk table. ``space``: ``docs`` (the archive), ``digest`` or ``address``.

    A row is a payload: its key, its chunks with their bytes, the chunks it is filed under, and the document
    it belongs to. ``owner``: the archive's id; ``first``: of a digest its document's first record, of an
    address its first record without digest; ``digest``: of an address the key of the first digest seen
    there, ``digest_payload`` its chunks. ``fresh`` rows say something the table didn't say before. ``threshold``: the least coverage
    the table can be asked for; an opened history keeps the one it was made with.
    """

    SCHEMA = "key binary, chunks array<struct<chunk: binary, bytes: int>>, filed array<binary>, owner string, first long, digest binary, digest_payload struct<chunks: array<struct<chunk: binary, bytes: int>>, filed: array<binary>>, fresh boolean"
    #: Parts of a space after which a commit puts them together.
    MOST_PARTS = 48

    def __init__(self, spark: SparkSession, folder: str | None = None, threshold: float = 1.0):
        self.spark, self.folder = spark, folder or f"{shared_dir(spark)}/newsloom/history-{uuid.uuid4().hex}"
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.version, self.parts, self.threshold = 0, {}, threshold
        self.waiting: dict[str, list[str]] = {}
        log = self._path(f"{self.folder}/log")
        if self._fs.exists(log):
            names = sorted(f.getPath().getName() for f in self._fs.listStatus(log))
            names = [n for n in names if re.fullmatch(r"\d{9}\.json", n)]
            if names:
                said = json.loads(self._read(f"log/{names[-1]}"))
                self.version, self.parts, self.threshold = int(names[-1][:9]), said["parts"], said["threshold"]

    def _read(self, name: str) -> str:
        raw = self._fs.open(self._path(f"{self.folder}/{name}"))
        try:
            return str(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(raw, "UTF-8"))
        finally:
            raw.close()

    def append(self, rows: DataFrame, space: str) -> DataFrame:
        """Writes a part that the next commit makes known, and returns it with all its columns."""
        name = f"{space}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder}/{name}")
        self.waiting.setdefault(space, []).append(name)
        return self.spark.read.schema(rows.schema).parquet(f"{self.folder}/{name}")

    def commit(self) -> None:
        """Makes the parts written since the last commit known, all or none."""
        if not self.waiting:
            return
        parts = {s: [*self.parts.get(s, []), *self.waiting.get(s, [])] for s in {*self.parts, *self.waiting}}
        self._publish(parts)
        self.waiting = {}
        if any(len(p) > self.MOST_PARTS for p in parts.values()):
            self.compact()

    def _publish(self, parts: dict[str, list[str]]) -> None:
        body = json.dumps({"parts": parts, "threshold": self.threshold}, sort_keys=True).encode()
        # The whole text is written aside first; a rename to a name that exists fails.
        aside = self._path(f"{self.folder}/log/.{uuid.uuid4().hex}")
        out = self._fs.create(aside, False)
        out.write(bytearray(body))
        out.close()
        name = self._path(f"{self.folder}/log/{self.version + 1:09d}.json")
        if self._fs.exists(name) or not self._fs.rename(aside, name):
            self._fs.delete(aside, False)
            raise RuntimeError(f"another writer has made version {self.version + 1} of {self.folder}; open it again")
        self.version, self.parts = self.version + 1, parts

    def compact(self) -> None:
        """One part a space, one row a payload; the parts it was made of stay for readers of older versions."""
        made = {}
        for space in sorted(self.parts):
            whole = self.table(space).groupBy("key").agg(*[F.min(c).alias(c) for c in ("owner", "first", "digest")], *[F.first(c, ignorenulls=True).alias(c) for c in ("chunks", "filed", "digest_payload")])
            made[space] = [f"{space}-{uuid.uuid4().hex}"]
            whole.withColumn("fresh", F.lit(True)).write.parquet(f"{self.folder}/{made[space][0]}")
        self._publish(made)

    def table(self, *spaces: str) -> DataFrame:
        parts = [f"{self.folder}/{p}" for s in spaces for p in self.parts.get(s, [])]
        if not parts:
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(*parts).where("fresh")

    def covered(self, space: str | Sequence[str], payloads: DataFrame, threshold: float | None = None, few: bool = False) -> DataFrame:
        """``key, other, shared_bytes, coverage`` and what is said of ``other``: what the table holds of ``payloads`` (``key, chunks``).

        A pair's coverage is the bytes of the chunks both have over the bytes of the longer. The table is
        met by chunk; only payloads filed under one of the asked chunks, and of fitting size, are compared.
        ``few``: the payloads are at most ``FEW``, so they go to the table, which isn't moved.
        """
        least = self.threshold if threshold is None else threshold
        if least < self.threshold:
            raise ValueError(f"this history is filed for coverages of at least {self.threshold}")
        all_, theirs = total_bytes("chunks"), total_bytes("their_chunks")
        asked = payloads.where(F.size("chunks") > 0).select("key", "chunks", all_.alias("total"), F.explode("chunks.chunk").alias("chunk"))
        asked = F.broadcast(asked) if few else asked
        held = self.table(*[space] if isinstance(space, str) else space).select(F.col("key").alias("other"), F.col("chunks").alias("their_chunks"), "owner", "first", "digest", "digest_payload", F.explode("filed").alias("chunk"))
        held = held.withColumn("their_total", theirs)
        fits = (F.least("total", "their_total") >= least * F.greatest("total", "their_total"))
        met = asked.join(held, (asked["chunk"] == held["chunk"]) & fits)
        met = met.withColumn("shared_bytes", total_bytes(F.array_intersect("chunks", "their_chunks"))).withColumn("coverage", F.col("shared_bytes") / F.greatest("total", "their_total"))
        return met.where(F.col("coverage") >= least).select("key", "other", "shared_bytes", "coverage", "owner", "first", "digest", "digest_payload")

    def known(self, space: str | Sequence[str], payloads: DataFrame, few: bool = False) -> DataFrame:
        """What the table says of the payloads it covers whole; the same chunks in another order are another payload."""
        held = self.covered(space, payloads, 1.0, few).where(F.col("key") == F.col("other"))
        return held.groupBy("key").agg(F.min("owner").alias("owner"), F.min("first").alias("first"), F.min(F.struct("digest", "digest_payload")).alias("d")).select("key", "owner", "first", "d.digest", "d.digest_payload")


def near_duplicates(history: History, space: str, payloads: DataFrame, threshold: float) -> DataFrame:
    """``key, other, coverage``: each payload (``key, chunks``) with the accepted one that covers most of it, the least key of equals."""
    best = F.min(F.struct((-F.col("coverage")).alias("less"), "other"))
    return history.covered(space, payloads, threshold).groupBy("key").agg(best.alias("x")).select("key", "x.other", (-F.col("x.less")).alias("coverage"))


def accept_payloads(history: History, space: str, payloads: DataFrame) -> None:
    """Enters payloads (``key, chunks, owner``) that are new to the history, and commits them."""
    rows = rarest_chunks(payloads.dropDuplicates(["key"]), history.threshold)
    history.append(rows.withColumn("fresh", F.lit(True)), space)
    history.commit()


def payloads_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``key, chunks, owner`` of any texts; equal texts are one payload, owned by the least id."""
    rows = df.where(F.col(text_col).isNotNull() & (F.col(text_col) != "")).groupBy(F.col(text_col).alias("payload")).agg(F.min(F.col(id_col).cast("string")).alias("owner"))
    return rows.select("owner", _payload_key("payload").alias("k")).select("k.key", "k.chunks", "owner")


def accept_archive(history: History, archive: DataFrame, id_col: str, digest_col: str) -> None:
    """Enter the archive, which is older than every batch; a digest belongs to its smallest id."""
    known = archive.select(digest_key(F.col(digest_col)).alias("payload"), F.col(id_col).cast("string").alias("owner")).where("payload is not null and owner is not null")
    accept_payloads(history, "docs", payloads_of(known, "owner", "payload"))


def prepare(history: History, records: DataFrame, batch_col: str, id_col: str, digest_col: str, url_col: str) -> DataFrame:
    """Records by the keys of what identifies them, with the chunks those are to be filed under, ready to be accepted."""
    rows = records.where(F.col(id_col).isNotNull()).select(
        F.col(batch_col).alias("batch"), F.col(id_col).cast("long").alias("n"), _payload_key(digest_key(F.col(digest_col))).alias("h"), F.pandas_udf(_address_frame, _KEY)(F.col(url_col)).alias("a")
    )
    rows = staged(history.spark, rows.dropDuplicates(["n"]), "keyed")
    for c in ("h", "a"):
        payloads = rows.where(F.col(c).isNotNull()).select(f"{c}.key", f"{c}.chunks").dropDuplicates(["key"])
        filed = rarest_chunks(payloads, history.threshold).select(F.col("key").alias("_k"), F.struct("chunks", "filed").alias(f"{c}c"))
        rows = rows.join(filed, F.col(f"{c}.key") == F.col("_k"), "left").drop("_k")
    return rows.select("batch", "n", F.col("h.key").alias("h"), "hc", F.col("a.key").alias("a"), "ac")


def accept_batch(history: History, rows: DataFrame, size: int | None = None, turn: int = 0) -> tuple[DataFrame, DataFrame]:
    """Enters a prepared batch; returns its addresses and its documents as they now stand (two parts).

    Batch and history meet by chunk: no record is compared with others one by one. What is new enters
    the history with the commit at the end. ``size``: the batch's records, counted if not given.
    """
    few = (rows.count() if size is None else size) <= FEW
    sent = F.broadcast if few else lambda df: df
    # Of each address in the batch: the first digest and the first record without one, now or earlier.
    hashed = F.min_by(F.struct(F.col("h").alias("digest"), F.col("hc").alias("digest_payload")), F.when(F.col("h").isNotNull(), F.col("n")))
    own = rows.where("a is not null").groupBy(F.col("a").alias("key")).agg(hashed.alias("d"), F.min(F.when(F.col("h").isNull(), F.col("n"))).alias("bare"), F.first("ac").alias("ac")).select("*", "ac.*")
    past = history.known("address", own, few).select("key", F.col("first").alias("kbare"), F.when(F.col("digest").isNotNull(), F.struct("digest", "digest_payload")).alias("kd"), F.lit(True).alias("old"))
    address = own.join(sent(past), "key", "left").withColumn("at", F.coalesce("kd", F.when(F.col("d.digest").isNotNull(), F.col("d")))).withColumn("first", F.least("bare", "kbare"))
    same = F.col("at.digest").eqNullSafe(F.col("kd.digest")) & F.col("first").eqNullSafe(F.col("kbare"))
    address = history.append(address.select("key", "chunks", "filed", "at.digest", "at.digest_payload", "first", (F.col("old").isNull() | ~same).alias("fresh"), F.lit(turn).alias("turn")), "address")
    joined = linked(rows, sent(address), ["hc"])
    # A document starts at its first record, be it one without digest at an address of its digest.
    start = F.when(F.col("h").isNull() | F.col("h").eqNullSafe(F.col("ah")), F.least("n", "bare")).otherwise(F.col("n"))
    docs = joined.where("doc is not null").groupBy(F.col("doc").alias("key")).agg(F.min(start).alias("first"), F.max(F.coalesce("h", "ah").isNotNull()).alias("hashed"), F.first(F.coalesce("hc", "ah_payload"), ignorenulls=True).alias("hc")).select("*", "hc.*")
    past = history.known(["digest", "docs"], docs, few).select("key", F.col("first").alias("kfirst"), "owner")
    docs = docs.join(sent(past), "key", "left").withColumn("first", F.least("first", "kfirst"))
    fresh = F.col("hashed") & (F.col("kfirst").isNull() | (F.col("first") < F.col("kfirst")))
    docs = history.append(docs.select("key", "chunks", "filed", "first", F.col("owner").alias("in_archive"), fresh.alias("fresh"), F.lit(turn).alias("turn")), "digest")
    history.commit()
    return address, docs


def linked(rows: DataFrame, address: DataFrame, keep: Sequence[str] = (), by: Sequence[str] = ()) -> DataFrame:
    """Records with what stands at their address, and the key of their document."""
    at = address.select(*by, F.col("key").alias("a"), F.col("digest").alias("ah"), F.col("digest_payload").alias("ah_payload"), F.col("first").alias("bare"))
    return rows.join(at, [*by, "a"], "left").withColumn("doc", F.coalesce("h", "ah", "a")).select(*by, "n", "h", "ah", "bare", "doc", *keep, *["ah_payload"] * bool(keep))


def duplicates(rows: DataFrame, address: DataFrame, docs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``record_no, match_kind, match_key`` of the duplicates of a batch, or with ``by`` of several."""
    told = linked(rows, address, by=by).join(docs.select(*by, F.col("key").alias("doc"), "first", F.col("in_archive").alias("owner")), [*by, "doc"], "left")
    earlier, in_docs = F.col("first") < F.col("n"), F.col("h").isNotNull() & F.col("owner").isNotNull()
    return told.where(in_docs | earlier).select(
        F.col("n").alias("record_no"), F.when(in_docs, "docs").otherwise("audit").alias("match_kind"), F.when(in_docs, F.col("owner")).otherwise(F.col("first").cast("string")).alias("match_key")
    )


def run_batches(history: History, records: DataFrame, batch_col: str, id_col: str, digest_col: str, url_col: str) -> DataFrame:
    """All batches of a table in their order; each reads its own rows and the chunk table."""
    rows = prepare(history, records, batch_col, id_col, digest_col, url_col).repartition("batch", F.pmod("n", F.lit(16))).sortWithinPartitions("batch")
    rows = staged(history.spark, rows, "prepared")
    sizes = dict(map(tuple, rows.groupBy("batch").count().collect()))  # one row a batch
    order = sorted(n for n in sizes if n is not None) + [None] * (None in sizes)
    if not order:
        return history.spark.createDataFrame([], "record_no long, match_kind string, match_key string")
    parts = [accept_batch(history, rows.where(F.col("batch").eqNullSafe(F.lit(b))), sizes[b], i) for i, b in enumerate(order)]
    of_batch = F.coalesce(*[F.when(F.col("batch").eqNullSafe(F.lit(b)), F.lit(i)) for i, b in enumerate(order)])
    address, docs = (history.spark.read.schema(parts[0][x].schema).parquet(*[f for p in parts for f in p[x].inputFiles()]) for x in (0, 1))
    return duplicates(rows.withColumn("turn", of_batch), address, docs, ["turn"])
