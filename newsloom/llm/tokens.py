"""Token ids of a whole corpus by a public tokenizer, through a minimal acyclic lexicon (problem 7).

One pass counts the words of all texts. The most frequent ``lexicon_words`` become a minimal
acyclic automaton over their bytes: states that accept the same endings are one, and the
numbers along a word's path add up to the word's place in a table of token ids. The automaton
is a flat file in the shared folder that every Python worker maps into memory. The second pass
splits each text by the tokenizer's pattern, looks the batch's distinct words up in the
automaton all at once and merges the words it doesn't hold by the tokenizer's own exact rule.

Defined results: null and empty texts have no ids (an empty list); special tokens' strings are
ordinary text; texts of any length are encoded whole; repeated rows get repeated results.
"""

from __future__ import annotations

import base64
import os
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.session import own_dir, staged

#: Words the lexicon holds at most; its file stays under about 2 MB.
LEXICON_WORDS = 32_768
#: Entries of a task's memo of words, after which it starts anew.
MEMO_WORDS = 300_000
#: Longest word that enters the lexicon or the counts, in characters; longer ones are merged exactly.
WORD_CHARS = 24


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> str:
    """Where a public vocabulary lies: in ``folder``, else where NEWSLOOM_TOKENIZERS says, else in /opt/tokenizers."""
    return os.path.join(folder or os.environ.get("NEWSLOOM_TOKENIZERS", "/opt/tokenizers"), name)


def word_pattern() -> str:
    """Fixed value: the pattern by which the byte-level vocabulary splits text."""
    return r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def load_encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("public", pat_str=word_pattern(), mergeable_ranks=ranks, special_tokens={})


class Lexicon:
    """Words to token ids: a minimal acyclic automaton whose path numbers index a table of ids."""

    FIELDS = (("first", np.int32), ("count", np.int32), ("key", np.int64), ("target", np.int32), ("skip", np.int32), ("final", np.uint8), ("start", np.int32), ("ids", np.int32))

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.__dict__.update(arrays)

    @classmethod
    def build(cls, words: dict[str, list[int]]) -> Lexicon:
        order = sorted((w.encode("utf-8"), ids) for w, ids in words.items() if w)
        register: dict[tuple, int] = {}
        states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []

        def frozen(node: list) -> int:
            shape = (node[0], tuple(node[1]))
            if shape not in register:
                register[shape] = len(states)
                states.append(shape)
            return register[shape]

        # Words come sorted: once a prefix is left, its state never changes and can be shared.
        path: list[list] = [[False, [], None]]
        last = b""
        for word, _ in order:
            common = os.path.commonprefix([word, last])
            while len(path) > len(common) + 1:
                node = path.pop()
                path[-1][1].append((node[2], frozen(node)))
            for byte in word[len(common) :]:
                path.append([False, [], byte])
            path[-1][0] = True
            last = word
        while len(path) > 1:
            node = path.pop()
            path[-1][1].append((node[2], frozen(node)))
        root = frozen(path[0])
        size = [0] * len(states)
        for s, (final, arcs) in enumerate(states):  # targets are numbered before their sources
            size[s] = final + sum(size[t] for _, t in arcs)
        key, target, skip = [], [], []
        for s, (final, arcs) in enumerate(states):
            before = int(final)
            for byte, t in arcs:
                key.append(s * 256 + byte)
                target.append(t)
                skip.append(before)
                before += size[t]
        start = np.r_[0, np.cumsum([len(ids) for _, ids in order])].astype(np.int32)
        return cls(
            {
                "first": np.array([root], np.int32), "count": np.array([len(order)], np.int32),
                "key": np.array(key, np.int64), "target": np.array(target, np.int32), "skip": np.array(skip, np.int32),
                "final": np.array([f for f, _ in states], np.uint8), "start": start,
                "ids": np.fromiter(chain.from_iterable(ids for _, ids in order), np.int32),
            }
        )

    def lookup(self, words: list[bytes]) -> np.ndarray:
        """Each word's place in the table, -1 for a word that isn't held; all words walk in step."""
        n = len(words)
        if not n or not len(self.key):
            return np.full(n, -1, np.int64)
        length = np.fromiter(map(len, words), np.int64, n)
        flat = np.frombuffer(b"".join(words), np.uint8)
        offset = np.r_[0, np.cumsum(length)[:-1]]
        state, place = np.full(n, int(self.first[0]), np.int64), np.zeros(n, np.int64)
        alive = np.flatnonzero(length > 0)
        place[length == 0] = -1
        step = 0
        while len(alive):
            want = state[alive] * 256 + flat[offset[alive] + step]
            arc = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
            hit = self.key[arc] == want
            place[alive[~hit]] = -1
            alive, arc = alive[hit], arc[hit]
            place[alive] += self.skip[arc]
            state[alive] = self.target[arc]
            step += 1
            ended = length[alive] == step
            done = alive[ended]
            place[done[self.final[state[done]] == 0]] = -1
            alive = alive[~ended]
        return place

    def ids_at(self, place: int) -> list[int]:
        return self.ids[self.start[place] : self.start[place + 1]].tolist()

    def to_bytes(self) -> bytes:
        head = np.array([len(getattr(self, f)) for f, _ in self.FIELDS], np.int64).tobytes()
        body = b"".join(b + b"\0" * (-len(b) % 8) for b in (np.ascontiguousarray(getattr(self, f), t).tobytes() for f, t in self.FIELDS))
        return head + body

    @classmethod
    def mapped(cls, path: str) -> Lexicon:
        """The lexicon in a file, mapped into memory and read only where it is used."""
        raw = np.memmap(path, np.uint8, "r")
        sizes = raw[: 8 * len(cls.FIELDS)].view(np.int64)
        arrays, at = {}, 8 * len(cls.FIELDS)
        for (name, kind), n in zip(cls.FIELDS, sizes):
            bytes_ = int(n) * np.dtype(kind).itemsize
            arrays[name] = raw[at : at + bytes_].view(kind)
            at += bytes_ + -bytes_ % 8
        return cls(arrays)


def publish(spark: SparkSession, content: bytes, label: str) -> str:
    """Write bytes to the shared folder; returns what ``local_copy`` turns into a path on any executor."""
    jvm = spark.sparkContext._jvm
    uri = f"{own_dir(spark)}/{label}-{uuid.uuid4().hex}.bin"
    path = jvm.org.apache.hadoop.fs.Path(uri)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(path, True)
    out.write(bytearray(content))
    out.close()
    whole = fs.makeQualified(path).toString()
    if not whole.startswith("file:"):
        spark.sparkContext.addFile(whole)
    return whole


def local_copy(uri: str) -> str:
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return SparkFiles.get(uri.rsplit("/", 1)[1])


def count_words(df: DataFrame, text_col: str) -> DataFrame:
    """``word, n`` over all texts, counted in the tasks before anything is shuffled."""
    pattern = word_pattern()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find, total = regex.compile(pattern).findall, Counter()

        def flush() -> pa.RecordBatch:
            kept = {w: n for w, n in total.items() if len(w) <= WORD_CHARS}
            total.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(kept), pa.string()), pa.array(list(kept.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    total.update(find(text))
                if len(total) > MEMO_WORDS:
                    yield flush()
        yield flush()

    return df.select(text_col).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def compile_lexicon(spark: SparkSession, df: DataFrame, text_col: str, vocabulary: str, lexicon_words: int = LEXICON_WORDS) -> str:
    """Counts the corpus' words and publishes the automaton of the most frequent ones."""
    # A histogram of counts (a few hundred rows) tells how frequent a word must be; only those words are brought here.
    counts = staged(spark, count_words(df, text_col).withColumn("level", F.floor(F.log2("n") * 16).cast("int")), "words")
    level, held = None, 0
    for r in sorted(counts.groupBy("level").count().collect(), reverse=True):
        held += r["count"]
        if held > lexicon_words:
            break
        level = r["level"]
    top = counts.where(F.col("level") >= level).select("word").toPandas()["word"] if level is not None else ()
    encoding = load_encoding(vocabulary)
    return publish(spark, Lexicon.build({w: encoding._encode_single_piece(w.encode("utf-8")) for w in top}).to_bytes(), "lexicon")


class _WordIds(dict):
    """A task's memo of words; a batch's new words are looked up together."""

    def __init__(self, lexicon: Lexicon, encoding):
        self.lexicon, self.encoding = lexicon, encoding

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self]
        if not new:
            return
        raw = [w.encode("utf-8", "surrogatepass") for w in new]
        for w, b, place in zip(new, raw, self.lexicon.lookup(raw)):
            self[w] = self.lexicon.ids_at(place) if place >= 0 else self.encoding._encode_single_piece(b)


def encode_corpus(spark: SparkSession, df: DataFrame, id_col: str, text_col: str, vocabulary: str | None = None, lexicon_words: int = LEXICON_WORDS, counts_only: bool = False, keep: str | None = None) -> DataFrame:
    """``doc_id, ids`` (or ``doc_id, n_tokens``) of every row; ``keep``: a string column that is passed through."""
    vocabulary = vocabulary or vocabulary_path()
    uri = compile_lexicon(spark, df, text_col, vocabulary, lexicon_words)
    pattern = word_pattern()
    spark.sparkContext.addFile(vocabulary)  # executors need no vocabulary of their own
    name = os.path.basename(vocabulary)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find = regex.compile(pattern).findall
        memo = _WordIds(Lexicon.mapped(local_copy(uri)), load_encoding(SparkFiles.get(name)))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo in range(0, len(texts), 1000):
                split = [find(t) if t else [] for t in texts[lo : lo + 1000]]
                if len(memo) > MEMO_WORDS:
                    memo.clear()
                memo.learn(set(chain.from_iterable(split)))
                flat: list[int] = []
                ends = [0]
                for words in split:
                    flat.extend(chain.from_iterable(map(memo.__getitem__, words)))
                    ends.append(len(flat))
                ids = batch.column(0).slice(lo, len(split))
                if counts_only:
                    value = pa.array(np.diff(np.array(ends, np.int64)))
                else:
                    value = pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(np.array(flat, np.int32)))
                kept = [batch.column(2).slice(lo, len(split))] if keep else []
                yield pa.RecordBatch.from_arrays([ids, value, *kept], [*names, *[keep] * bool(keep)])

    names = ["doc_id", "n_tokens" if counts_only else "ids"]
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *[F.col(c) for c in [keep] if c])
    return rows.mapInArrow(encode, ("doc_id long, n_tokens long" if counts_only else "doc_id long, ids array<int>") + (f", {keep} string" if keep else ""))
