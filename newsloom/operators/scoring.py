"""Explainable scores, ordered risk scans, flags with boilerplate scrubbed, questions, categories.

Lexicons, weights and thresholds are parameters: which words count is the newsroom's decision,
how they are counted is this module's. All scores are sums of columns, so a table is scored in
one scan.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from newsloom.functions.text import any_of, around, has_any_term, has_term, term_hits
from newsloom.functions.urls import host
from newsloom.operators.retrieval import packed_paragraphs


@dataclass(frozen=True)
class Rule:
    """One step of a score: by default adds ``weight`` if any term (or the pattern) stands in the text.

    ``per_hit`` adds it for each term. ``kind`` ``floor`` or ``cap`` bounds the score reached so far, so what
    comes later still adds to it. ``needs``: lists of which each must have a term in the text; ``unless``: terms
    that forbid the step; ``where``: makes a condition on other columns. A step that applied is a reason.
    """

    name: str
    terms: Sequence[str] = ()
    weight: int = 0
    per_hit: bool = False
    unless: Sequence[str] = ()
    kind: str = "add"
    pattern: str | None = None
    needs: Sequence[Sequence[str]] = ()
    where: Callable[[], Column] | None = None


@dataclass(frozen=True)
class Rulebook:
    rules: Sequence[Rule]
    buckets: Sequence[tuple[str, int]] = (("high", 8), ("maybe", 5))
    low: str = "low"
    floors: Sequence[tuple[Sequence[str], int]] = field(default_factory=tuple)


def _applies(rule: Rule, text: Column) -> Column:
    said = [has_any_term(text, rule.terms)] if rule.terms else []
    if rule.pattern:
        said.append(F.lower(text).rlike(rule.pattern))
    hit = any_of(said) if said else F.lit(True)
    for group in rule.needs:
        hit = hit & has_any_term(text, group)
    if rule.unless:
        hit = hit & ~has_any_term(text, rule.unless)
    return F.coalesce(hit & rule.where() if rule.where else hit, F.lit(False))


def score(df: DataFrame, text: Column, book: Rulebook) -> DataFrame:
    """Adds ``score``, ``bucket`` and ``reasons``; the rules are steps taken in their order."""
    total, reasons = F.lit(0), []
    steps = [*book.rules, *(Rule("", terms, floor, kind="floor") for terms, floor in book.floors)]
    for r in steps:
        hit = _applies(r, text)
        if r.kind == "floor":
            total = F.greatest(total, F.when(hit, F.lit(r.weight)))  # nulls don't count
        elif r.kind == "cap":
            total = F.least(total, F.when(hit, F.lit(r.weight)))
        elif r.per_hit:
            total = total + F.when(hit, sum((has_term(text, t).cast("int") for t in r.terms), F.lit(0)) * r.weight).otherwise(0)
        else:
            total = total + F.when(hit, r.weight).otherwise(0)
        if r.name:
            reasons.append(F.when(hit, F.lit(r.name)))
    out = df.withColumn("score", total).withColumn("reasons", F.array_compact(F.array(*reasons)))
    bucket = F.coalesce(*[F.when(F.col("score") >= at, F.lit(name)) for name, at in book.buckets], F.lit(book.low))
    return out.withColumn("bucket", bucket)


def categories(text: Column, table: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """Every category any of whose keywords is a substring of the text, in the table's order."""
    low = F.lower(text)
    return F.array_compact(F.array(*[F.when(any_of([low.contains(k) for k in keys]), F.lit(name)) for name, keys in table]))


def included(text: Column, include: Sequence[str], exclude: Sequence[str]) -> Column:
    low = F.lower(text)
    return any_of([low.contains(t) for t in include]) & ~any_of([low.contains(t) for t in exclude])


def relevant(text: Column, include: Sequence[str], call_signs: Column, keywords: Column, weak: Sequence[str]) -> Column:
    """A section worth reading, or a call sign together with a keyword that isn't weak.

    The two modes of the predicate are two ``include`` lists. Null arrays hold nothing.
    """
    strong = F.exists(F.coalesce(keywords, F.array().cast("array<string>")), lambda k: ~F.lower(k).isin(*weak))
    return F.coalesce(any_of([F.lower(text).contains(t) for t in include]), F.lit(False)) | ((F.coalesce(F.size(call_signs), F.lit(0)) > 0) & F.coalesce(strong, F.lit(False)))


@dataclass(frozen=True)
class RiskPattern:
    """``soft``: watchlist unless a stress marker is near. ``stock``: phrases near a hit that make it boilerplate;
    ``lead``: the same in the ``LEAD`` characters before it; ``needs``: boilerplate unless one of these is near."""

    label: str
    pattern: str
    soft: bool = False
    stock: Sequence[str] = ()
    lead: Sequence[str] = ()
    needs: Sequence[str] = ()
    stress: Sequence[str] = ()


#: Characters before a hit in which a sentence that only says what auditors do begins.
LEAD = 160


def _plain(c: Column) -> Column:
    """Typographic quotes plain, white space collapsed."""
    return F.trim(F.regexp_replace(F.translate(c, "’‘“”", "''\"\""), r"\s+", " "))


def risk_scan(docs: DataFrame, group: str, order: Sequence[str], title: str, text: str, patterns: Sequence[RiskPattern], boilerplate: Sequence[str] = (), stress: Sequence[str] = (), on_soft_hit: str = "continue", strict: bool = False, before: int = 320, after: int = 420) -> DataFrame:
    """``group, title, label, tier, snippet``: the first match of each ordered pattern in each document.

    A hit amid boilerplate, or of a soft pattern without a stress marker near it, is ``watchlist``,
    others are ``higher``. ``continue``: later patterns of a document are tried after any hit but a
    higher one; ``break``: the first matching pattern decides the document. Of equal
    (group, title, label) only the first document in the order counts.
    """
    used = [p for p in patterns if not (strict and p.soft)]
    at = F.array(*[F.struct(F.lit(i).alias("pattern_pos"), F.lit(p.label).alias("label"), F.regexp_instr(F.lower(F.col(text)), F.lit(p.pattern)).alias("at")) for i, p in enumerate(used)])
    hits = docs.select(group, *order, title, text, F.explode(F.filter(at, lambda x: x["at"] > 0)).alias("h")).select(group, *order, title, text, "h.*")
    start = F.greatest(F.col("at") - before, F.lit(1))
    lead = F.greatest(F.col("at") - LEAD, F.lit(1))
    hits = hits.withColumn("context", _plain(F.substring(F.lower(F.col(text)), start, F.col("at") - start + after))).withColumn("_lead", _plain(F.substring(F.lower(F.col(text)), lead, F.col("at") - lead))).drop(text)
    near = lambda phrases, where="context": any_of([F.col(where).contains(x) for x in phrases])
    is_stock, is_calm = [], []
    for i, p in enumerate(used):
        this = F.col("pattern_pos") == i
        is_stock.append(this & (near([*boilerplate, *p.stock]) | near(p.lead, "_lead") | (~near(p.needs) if p.needs else F.lit(False))))
        if p.soft:
            is_calm.append(this & ~near([*stress, *p.stress]))
    hits = hits.withColumn("tier", F.when(any_of(is_stock) | any_of(is_calm), "watchlist").otherwise("higher")).withColumn("snippet", F.substring("context", 1, 240))
    key = F.struct(*[F.col(o) for o in order])
    # The same title may be archived twice: its first document in the order speaks for it.
    firsts = hits.groupBy(group, title, "label").agg(F.min_by(F.struct(*order, "pattern_pos", "tier", "snippet"), key).alias("x")).select(group, title, "label", "x.*")
    stop = F.col("pattern_pos") if on_soft_hit == "break" else F.when(F.col("tier") == "higher", F.col("pattern_pos"))
    # A document has no more hits than there are patterns.
    ends = firsts.withColumn("_stop", F.min(stop).over(W.partitionBy(group, *order)))
    return ends.where(F.col("_stop").isNull() | (F.col("pattern_pos") <= F.col("_stop"))).drop("_stop")


def risk_rollup(hits: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """One row a group: its first higher hit, else its first on the watchlist, with counts of both."""
    rank = F.struct((F.col("tier") != "higher").cast("int"), *order, "pattern_pos")
    return hits.groupBy(group).agg(
        F.min_by("tier", rank).alias("tier"), F.min_by("label", rank).alias("label"), F.min_by("title", rank).alias("title"),
        F.count_if(F.col("tier") == "higher").alias("higher_hits"), F.count_if(F.col("tier") == "watchlist").alias("watchlist_hits"),
    )


def scrubbed_flags(text: Column, flags: Sequence[tuple[str, str, Sequence[str]]]) -> Column:
    """Labels whose pattern is still found after its boilerplate spans are cut out of the text."""
    low = F.lower(text)
    out = []
    for label, pattern, stock in flags:
        clean = low
        for s in stock:
            clean = F.regexp_replace(clean, s, " ")
        out.append(F.when(clean.rlike(pattern), F.lit(label)))
    return F.array_compact(F.array(*out))


def question_score(text: Column, words: Sequence[str], markers: Sequence[str], boilerplate: Sequence[str]) -> Column:
    """4 for each of the question's words, 2 for each marker, less 6 for boilerplate."""
    low = F.lower(text)
    hits = F.size(term_hits(low, words)) * 4 + F.size(term_hits(low, markers)) * 2
    return hits - F.when(any_of([low.contains(b) for b in boilerplate]), 6).otherwise(0)


def excerpts(text: Column, words: Sequence[str], markers: Sequence[str], boilerplate: Sequence[str], sections: Sequence[str] = (), keep: int = 2, size: int = 700, window: int = 900) -> Column:
    """The ``keep`` best parts of a text (``excerpt, score``): its paragraphs, and windows around section patterns with 8 more.

    Best score first, then the longer; parts that begin with the same 120 characters are one. Parts without a
    positive score don't count; a null text has none.
    """
    rated = lambda c, more: F.transform(c, lambda x: F.struct(x.alias("t"), (question_score(x, words, markers, boilerplate) + more).alias("s")))
    found = rated(packed_paragraphs(text, size), 0)
    if sections:
        found = F.concat(rated(F.array_compact(F.array(*[around(text, p, 0, window + 300) for p in sections])), 8), found)
    cut = lambda x, most: F.when(F.length(x) > most, F.concat(F.substring(x, 1, most), F.lit("..."))).otherwise(x)
    shown = F.transform(F.filter(found, lambda x: x["s"] > 0), lambda x: F.struct((-x["s"]).alias("less"), (-F.length(cut(x["t"], window))).alias("shorter"), cut(x["t"], window).alias("excerpt")))
    best = F.array_sort(shown)
    first = lambda done, x: F.when(F.exists(done, lambda y: F.substring(y["excerpt"], 1, 120) == F.substring(x["excerpt"], 1, 120)) | (F.size(done) >= keep), done).otherwise(F.concat(done, F.array(x)))
    kept = F.aggregate(best, F.slice(best, F.lit(1), F.lit(0)), first)
    return F.transform(kept, lambda x: F.struct(x["excerpt"].alias("excerpt"), (-x["less"]).alias("score")))


def row_scores(df: DataFrame, title: str, text: str, year: Column, words: Sequence[str], markers: Sequence[str], boilerplate: Sequence[str], sections: Sequence[str] = ()) -> DataFrame:
    """Adds ``excerpts`` and ``score``: 4 for each of the question's words, 3 times the best excerpt's score, 1 for any marker, 2 for a year."""
    hay = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(text, F.lit(""))))
    out = df.withColumn("excerpts", excerpts(F.col(text), words, markers, boilerplate, sections))
    best = F.coalesce(F.get("excerpts", F.lit(0))["score"], F.lit(0))
    return out.withColumn("score", F.size(term_hits(hay, words)) * 4 + best * 3 + any_of([hay.contains(m) for m in markers]).cast("int") + F.when(year > 0, 2).otherwise(0))


def best_sentences(df: DataFrame, id_col: str, text: str, words: Sequence[str], boilerplate: Sequence[str], least: int = 25, most: int = 320) -> DataFrame:
    """``id, sentence, hits``: each text's sentence with most of the words, the first of equals."""
    parts = df.select(id_col, F.posexplode(F.split(F.regexp_replace(F.trim(text), r"\s+", " "), r"(?<=[.!?]) ")).alias("pos", "sentence")).where(F.length("sentence") >= least)
    low = F.lower("sentence")
    hits = F.size(term_hits(low, words)) - F.when(any_of([low.contains(b) for b in boilerplate]), 2).otherwise(0)
    best = parts.withColumn("hits", hits).groupBy(id_col).agg(F.min_by(F.struct("sentence", "hits"), F.struct(-F.col("hits"), F.col("pos"))).alias("x"))
    return best.select(id_col, F.substring("x.sentence", 1, most).alias("sentence"), F.col("x.hits").alias("hits")).where("hits > 0")


def ordered_label(text: Column, table: Sequence[tuple[str, Sequence[str]]], default: str) -> Column:
    """The first label any of whose substrings the text holds."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.coalesce(*[F.when(any_of([low.contains(k) for k in keys]), F.lit(name)) for name, keys in table], F.lit(default))


def page_score(url: Column, text: Column, keywords: Sequence[str], vetoes: Sequence[tuple[str, int]], name_tokens: Column | None = None, home: Column | None = None) -> Column:
    """Vetoes first; else 2 a keyword, up to 6 for the name's words in the address, 5 on the host ``home``, 1 for depth and 1 for https."""
    both = F.lower(F.concat_ws(" ", url, text))
    total = sum((F.when(both.contains(k), 2).otherwise(0) for k in keywords), F.lit(0))
    if name_tokens is not None:
        total = total + F.least(F.lit(6), 2 * F.size(F.filter(name_tokens, lambda t: F.contains(F.lower(url), t))))
    if home is not None:
        total = total + F.when(host(url) == F.lower(home), 5).otherwise(0)
    total = total + F.when(F.size(F.split(F.regexp_replace(url, "^[a-z]+://", ""), "/")) > 2, 1).otherwise(0) + F.when(F.lower(url).startswith("https://"), 1).otherwise(0)
    return F.coalesce(*[F.when(both.contains(v), F.lit(w)) for v, w in vetoes], total) if vetoes else total


def snippet_windows(df: DataFrame, id_col: str, order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows a document in an order."""
    return df.withColumn("place", F.row_number().over(W.partitionBy(id_col).orderBy(*order))).where(F.col("place") <= k)
