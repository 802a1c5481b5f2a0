"""A training mixture of sources by target shares of tokens, with capped repetition (problem 8).

Each source may be used at most ``max_repeats`` times over. Capped water-filling gives each its
share of the total; a source that would need more is held at its cap and what it can't take goes
to the others in proportion to their shares, until all fit. A source's allotment is cut into
whole repetitions of all its records and a seeded part of them for the rest.

Scale: the records of the partial repetition are those of smallest seeded hash. A histogram of
hash ranges (``BUCKETS`` a source) finds the range in which the allotment is used up; only that
range's records are put in order, so no source is ever sorted as a whole or held by one task.

Defined results: sources without target, and records of null source, get no copies and no row;
empty and null texts have no tokens and are never drawn; repeated rows of an id count as rows;
a target without records reaches a share of 0.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from newsloom.llm.tokens import encode_corpus
from newsloom.session import staged

#: Hash ranges of a source's histogram.
BUCKETS = 4_096


@dataclass
class Allotment:
    source: str
    target_share: float
    max_repeats: int
    available: int
    tokens: float
    clamped: bool = False


def water_fill(targets: list[tuple[str, float, int]], available: dict[str, int], total: float | None = None, stretch: float = 1.0) -> list[Allotment]:
    """How many tokens each source gives to a mixture of ``total`` tokens.

    ``total`` None: ``stretch`` times the largest mixture that has every target share exactly. A larger
    total clamps sources at their caps; one beyond all caps together gives all caps.
    """
    rows = [Allotment(s, w, r, available.get(s, 0), 0.0) for s, w, r in sorted(targets)]
    cap = {a.source: float(a.available * a.max_repeats) for a in rows}
    if total is None:
        fitting = [cap[a.source] / a.target_share for a in rows if a.target_share > 0 and cap[a.source] > 0]
        total = stretch * min(fitting, default=0.0)
    open_ = [a for a in rows if a.target_share > 0 and cap[a.source] > 0]
    left = min(float(total), sum(cap[a.source] for a in open_))
    while open_:
        weight = sum(a.target_share for a in open_)
        over = [a for a in open_ if left * a.target_share / weight > cap[a.source] * (1 + 1e-12)]
        if not over:
            for a in open_:
                a.tokens = left * a.target_share / weight
            break
        for a in over:
            a.tokens, a.clamped = cap[a.source], True
        left -= sum(a.tokens for a in over)
        open_ = [a for a in open_ if not a.clamped]
    return rows


@dataclass
class Mixture:
    records: DataFrame
    allotments: list[Allotment]

    def shares(self, spark: SparkSession) -> DataFrame:
        """One row a target: what was wanted, what was available and what was reached."""
        plan = spark.createDataFrame(
            [(a.source, float(a.target_share), int(a.max_repeats), int(a.available), float(a.tokens), a.clamped) for a in self.allotments],
            "source string, target_share double, max_repeats int, available_tokens long, allotted_tokens double, clamped boolean",
        )
        got = self.records.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("t"), F.sum("copies").alias("c"), F.max("copies").alias("m"))
        out = plan.join(got, "source", "left").select(*plan.columns, *[F.coalesce(F.col(x), F.lit(0)).alias(n) for x, n in (("t", "reached_tokens"), ("c", "record_uses"), ("m", "most_repeats"))])
        return out.withColumn("reached_share", F.col("reached_tokens") / F.greatest(F.sum("reached_tokens").over(W.partitionBy()), F.lit(1)))


def mix_sources(spark: SparkSession, sizes: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 11, stretch: float = 1.0) -> Mixture:
    """``doc_id, source, n_tokens, copies`` of every record the mixture uses. ``sizes``: ``doc_id, source, n_tokens``.

    ``targets`` is a configuration table, one row a source; it is the only table brought to the driver whole.
    """
    wanted = [(r["source"], r["target_share"], r["max_repeats"]) for r in targets.where("source is not null").dropDuplicates(["source"]).collect()]
    names = [w[0] for w in wanted]
    hash_ = F.xxhash64(F.lit(seed), "doc_id")
    sized = staged(spark, sizes.where(F.col("source").isin(names) & (F.col("n_tokens") > 0)).withColumn("h", hash_).withColumn("bucket", F.pmod("h", F.lit(BUCKETS)).cast("int")), "mixture-sizes")
    histogram: dict[str, dict[int, int]] = {}
    for r in sized.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("t")).collect():  # at most BUCKETS rows a target
        histogram.setdefault(r["source"], {})[r["bucket"]] = r["t"]
    plan = water_fill(wanted, {s: sum(b.values()) for s, b in histogram.items()}, total, stretch)
    cuts = []
    for a in plan:
        if not a.available:
            continue
        whole = min(int(a.tokens / a.available + 1e-9), a.max_repeats)
        rest = max(0.0, a.tokens - whole * a.available)
        cut, used = 0, 0
        while cut < BUCKETS and used + histogram[a.source].get(cut, 0) <= rest + 0.5:
            used += histogram[a.source].get(cut, 0)
            cut += 1
        # A source with all its repetitions used has nothing left to draw.
        if whole == a.max_repeats:
            cut, used, rest = 0, 0, 0.0
        cuts.append((a.source, whole, cut, rest - used))
    rules = spark.createDataFrame(cuts, "source string, whole int, cut int, rest double")
    marked = sized.join(F.broadcast(rules), "source")  # one row a target
    inside = marked.where(F.col("bucket") != F.col("cut")).withColumn("extra", (F.col("bucket") < F.col("cut")).cast("int"))
    run = F.sum("n_tokens").over(W.partitionBy("source").orderBy("h", "doc_id").rowsBetween(W.unboundedPreceding, 0))
    edge = marked.where(F.col("bucket") == F.col("cut")).withColumn("extra", (run <= F.col("rest")).cast("int"))
    records = inside.unionByName(edge).withColumn("copies", F.col("whole") + F.col("extra")).where("copies > 0").select("doc_id", "source", "n_tokens", "copies")
    return Mixture(records, plan)


def token_sizes(spark: SparkSession, documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, source, n_tokens``: sizes in tokens of the public tokenizer, joined to the trimmed source."""
    labelled = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.trim("source").alias("source"), "text")
    return encode_corpus(spark, labelled, "doc_id", "text", vocabulary, counts_only=True, keep="source")
