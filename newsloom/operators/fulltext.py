"""Full text: a token index over several columns, kept sorted by token, and a query language over it.

A query is words (all must stand in a row), ``"phrases"``, ``prefix*``, ``column:word``, ``OR``, ``NOT``,
``NEAR(a b, 5)`` and parentheses; ``NOT`` binds before ``AND`` (written or not), ``AND`` before ``OR``. Case and
marks on letters don't count. Every part of a query is a set of ids from the index, so a query costs the
postings of its words: with a stored index only their row groups are read.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Letters with marks lie in these ranges; the table from them to bare letters follows from the character database.
_MARKED = (range(0xC0, 0x250), range(0x1E00, 0x1F00))


def _bare(c: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))


def fold(text: str) -> str:
    return "".join(b if len(b := _bare(c)) == 1 else c for c in text.lower())


def folded(c: Column | str) -> Column:
    """Lower case without marks on letters."""
    marked = [chr(i) for r in _MARKED for i in r if len(_bare(chr(i))) == 1 and _bare(chr(i)) != chr(i) and chr(i).islower()]
    return F.regexp_replace(F.translate(F.lower(c), "".join(marked), "".join(map(_bare, marked))), r"\p{Mn}", "")


def token_index(df: DataFrame, id_col: str, columns: Sequence[str]) -> DataFrame:
    """``token, id, col, positions``; null texts have no tokens."""
    parts = []
    for c in columns:
        words = F.regexp_extract_all(folded(F.col(c)), F.lit(r"([\p{L}\p{N}]+)"), 1)
        parts.append(df.select(F.col(id_col).alias("id"), F.lit(c).alias("col"), F.posexplode(words).alias("pos", "token")))
    return reduce(DataFrame.unionByName, parts).groupBy("token", "id", "col").agg(F.array_sort(F.collect_list("pos")).alias("positions"))


def write_index(index: DataFrame, path: str) -> None:
    """Sorted by token over all files, so a look-up reads the row groups of its words only."""
    index.repartitionByRange("token").sortWithinPartitions("token", "id").write.mode("overwrite").option("parquet.block.size", 8 << 20).parquet(path)


def open_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def kept_index(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The index stored at ``path``; it is built and written only where none is."""
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        write_index(build(), path)
    return open_index(spark, path)


_LEX = re.compile(r'\s*(?:(NEAR)\s*\(|([()])|([\w]+)\s*:(?=\s*["\w])|"([^"]*)"(\*?)|,\s*(\d+)|([^\s()",:*]+)(\*?))')


def parse(query: str) -> tuple:
    """The query as a tree: ``(and|or|not, left, right)``, ``(near, terms, n)`` or ``(term, words, prefix, column)``."""
    found, at, query = [], 0, query.rstrip()
    while at < len(query):
        m = _LEX.match(query, at)
        if not m or m.end() == at:
            raise ValueError(f"cannot read the query at {query[at:at + 20]!r}")
        near, paren, column, phrase, star, number, word, star2 = m.groups()
        if near:
            found.append(("near",))
        elif paren:
            found.append((paren,))
        elif column:
            found.append(("column", column.lower()))
        elif number:
            found.append(("number", int(number)))
        elif phrase is not None:
            found.append(("words", phrase, bool(star)))
        else:
            found.append((word,) if word in ("AND", "OR", "NOT") else ("words", word, bool(star2)))
        at = m.end()
    tree, rest = _either(found, 0)
    if rest != len(found):
        raise ValueError("a parenthesis is closed that was never opened")
    return tree


def _term(found: list, at: int) -> tuple[tuple, int]:
    column = None
    if at < len(found) and found[at][0] == "column":
        column, at = found[at][1], at + 1
    if at >= len(found):
        raise ValueError("the query ends too early")
    if found[at][0] == "(":
        tree, at = _either(found, at + 1)
        if at >= len(found) or found[at][0] != ")":
            raise ValueError("a parenthesis is not closed")
        return tree, at + 1
    if found[at][0] == "near":
        terms, at, n = [], at + 1, 10
        while at < len(found) and found[at][0] == "words":
            terms.append(_words(found[at], None))
            at += 1
        if at < len(found) and found[at][0] == "number":
            n, at = found[at][1], at + 1
        if not terms or at >= len(found) or found[at][0] != ")":
            raise ValueError("NEAR takes words and, after a comma, a number")
        return ("near", terms, n), at + 1
    if found[at][0] != "words":
        raise ValueError(f"unexpected {found[at][0]}")
    return _words(found[at], column), at + 1


def _words(lexed: tuple, column: str | None) -> tuple:
    words = re.findall(r"[^\W_]+", fold(lexed[1]))
    if not words:
        raise ValueError("a term without letters or digits")
    return ("term", words, lexed[2], column)


def _without(found: list, at: int) -> tuple[tuple, int]:
    tree, at = _term(found, at)
    while at < len(found) and found[at][0] == "NOT":
        right, at = _term(found, at + 1)
        tree = ("not", tree, right)
    return tree, at


def _all(found: list, at: int) -> tuple[tuple, int]:
    tree, at = _without(found, at)
    while at < len(found) and found[at][0] not in ("OR", ")"):
        right, at = _without(found, at + (found[at][0] == "AND"))
        tree = ("and", tree, right)
    return tree, at


def _either(found: list, at: int) -> tuple[tuple, int]:
    tree, at = _all(found, at)
    while at < len(found) and found[at][0] == "OR":
        right, at = _all(found, at + 1)
        tree = ("or", tree, right)
    return tree, at


def _starts(index: DataFrame, term: tuple) -> DataFrame:
    """``id, col, start`` of a term's occurrences: the places of its words, moved to its start, must meet."""
    _, words, prefix, column = term
    held = index if column is None else index.where(F.lower("col") == column)
    parts = []
    for i, w in enumerate(words):
        is_word = F.col("token").startswith(w) if prefix and i == len(words) - 1 else F.col("token") == w
        parts.append(held.where(is_word).select("id", "col", F.explode("positions").alias("p")).select("id", "col", (F.col("p") - i).alias("start"), F.lit(i).alias("part")))
    every = reduce(DataFrame.unionByName, parts)
    if len(words) == 1:
        return every.select("id", "col", "start").distinct()
    return every.groupBy("id", "col", "start").agg(F.countDistinct("part").alias("n")).where(F.col("n") == len(words)).select("id", "col", "start")


def _near(index: DataFrame, terms: Sequence[tuple], n: int) -> DataFrame:
    """Ids with a column in which all terms stand, with at most ``n`` words between the end of one and the start of the last."""
    parts = [_starts(index, t).withColumn("term", F.lit(i)).withColumn("end", F.col("start") + len(t[1])) for i, t in enumerate(terms)]
    at = reduce(DataFrame.unionByName, parts).groupBy("id", "col").agg(*[F.array_sort(F.collect_list(F.when(F.col("term") == i, F.struct("start", "end")))).alias(f"t{i}") for i in range(len(terms))])
    begin = F.concat(*[F.col(f"t{i}") for i in range(len(terms))])
    meets = F.exists(begin, lambda a: reduce(lambda x, y: x & y, [F.exists(F.col(f"t{i}"), lambda b: (b["start"] >= a["start"]) & (b["start"] - a["end"] <= n)) for i in range(len(terms))]))
    return at.where(meets).select("id").distinct()


def search(index: DataFrame, query: str | tuple) -> DataFrame:
    """The distinct ``id`` of the rows that a query finds."""
    tree = parse(query) if isinstance(query, str) else query
    if tree[0] == "near":
        return _near(index, tree[1], tree[2])
    if tree[0] == "term":
        if len(tree[1]) == 1 and tree[3] is None:
            return index.where(F.col("token").startswith(tree[1][0]) if tree[2] else F.col("token") == tree[1][0]).select("id").distinct()
        return _starts(index, tree).select("id").distinct()
    left, right = search(index, tree[1]), search(index, tree[2])
    if tree[0] == "or":
        return left.unionByName(right).distinct()
    return left.join(right, "id", "left_semi" if tree[0] == "and" else "left_anti")


def first_rows(docs: DataFrame, id_col: str, hits: DataFrame, n: int) -> DataFrame:
    """The rows of the hits in the order of their ids, ``n`` at most: a search without a ranking."""
    return docs.join(hits, docs[id_col] == hits["id"], "left_semi").orderBy(id_col).limit(n)
