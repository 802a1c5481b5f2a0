"""Cutting oversized texts at natural boundaries, by content-defined chunking (problem 2).

A rolling hash over the text marks landmarks that depend on the nearby characters only. Between
the least and the greatest size of a piece the cut goes to the natural boundary nearest to the
landmark: to a paragraph's end if the range holds one, else to a sentence's, else to a word's,
else to the landmark itself. An edit moves the landmarks near it and no others, so only the
pieces beside it change. Consecutive pieces share exactly ``overlap`` characters, and
``pieces[0] + pieces[1][overlap:] + ...`` gives the text back.

Defined results: null, empty and short texts (at most ``limit`` characters) are not oversized
and give no row; texts of one unbroken stretch are cut inside it; white space of any kind and any
line ends (LF, CRLF, CR) count; positions are Unicode code points; repeated rows are cut alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVELS = ("paragraph", "sentence", "word", "none")

#: Abbreviations whose full stop ends no sentence.
ABBREVIATIONS = frozenset(
    "dr mr mrs ms prof gov sen rep st sr jr rev hon pres supt gen col maj capt lt sgt cpl adm cmdr fr messrs mme atty amb "
    "jan feb mar apr jun jul aug sep sept oct nov dec mon tue tues wed thu thur thurs fri sat sun "
    "inc co corp ltd llc dept univ assn bros mfg intl natl div est ext fig figs no nos vol vols pp pg ch sec art ed eds cf vs viz al approx "
    "ave blvd rd ln hwy ft mt pt sta tel sra srta dra lic ud uds etc núm art pág av mlle mm m me".split()
)
_PARAGRAPH_GAP = re.compile(r"(?:\r\n|\n|\r(?!\n))(?:[^\S\r\n]*(?:\r\n|\n|\r(?!\n)))+")
_STOP = re.compile(r"[.!?…]+[\"'”’»)\]]*(?=\s|$)")
_WORD_BEFORE = re.compile(r"(\S+)$")
#: Characters of the rolling hash's window.
WINDOW = 32
#: One position in so many is a landmark.
LANDMARK_EVERY = 256
_SPACES = np.array([c for c in range(0x3001) if chr(c).isspace()], np.uint32)


def landmark_hash(points: np.ndarray) -> np.ndarray:
    """Rolling hash of the ``WINDOW`` characters up to each position, by doubling."""
    x = points.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    h, size = x ^ (x >> np.uint64(31)), 1
    while size < WINDOW:
        older = np.zeros_like(h)
        older[size:] = h[:-size] if len(h) > size else h[:0]
        h = h + (older << np.uint64(size))
        size *= 2
    return h


def paragraphs(text: str) -> list[tuple[int, int]]:
    """Begin and end of each paragraph, without white space around it."""
    out, at = [], 0
    for gap in [*_PARAGRAPH_GAP.finditer(text), None]:
        end = gap.start() if gap else len(text)
        part = text[at:end]
        body = part.strip()
        if body:
            begin = at + len(part) - len(part.lstrip())
            out.append((begin, begin + len(body)))
        at = gap.end() if gap else end
    return out


def _ends_sentence(text: str, begin: int, stop: re.Match) -> bool:
    mark = stop.group()
    if mark[0] in "!?…" or len(mark) > 1 and mark[1] in ".!?…":
        return True
    word = _WORD_BEFORE.search(text, max(begin, stop.start() - 40), stop.start())
    bare = word.group(1).lstrip("(\"'“‘«[¿¡") if word else ""
    after = text[stop.end() : stop.end() + 80].lstrip()[:1]
    if after.islower():
        return False
    if bare.lower() in ABBREVIATIONS and not (bare.lower() == "no" and not after.isdigit()):
        return False
    # Initials and dotted abbreviations: J. Smith, U.S. Senate, 9 a.m. Monday
    return not re.fullmatch(r"[^\W\d_](?:\.[^\W\d_])*", bare)


def sentences(text: str, begin: int, end: int) -> list[tuple[int, int]]:
    """Begin and end of the sentences of one paragraph."""
    out, at = [], begin
    for stop in _STOP.finditer(text, begin, end):
        if stop.end() < end and _ends_sentence(text, begin, stop):
            out.append((at, stop.end()))
            at = stop.end()
            while at < end and text[at].isspace():
                at += 1
    if at < end:
        out.append((at, end))
    return out


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Spans of the paragraphs, sentences and words, and the code points."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    space = np.isin(points, _SPACES)
    edge = np.flatnonzero(np.r_[True, space] != np.r_[space, True])
    words = edge.reshape(-1, 2)
    paras = paragraphs(text)
    sents = [s for p in paras for s in sentences(text, *p)]
    return np.array(paras, np.int64).reshape(-1, 2), np.array(sents, np.int64).reshape(-1, 2), words, points


def cut_level(paras: np.ndarray, sents: np.ndarray, words: np.ndarray, limit: int) -> str:
    for level, spans in zip(LEVELS, (paras, sents, words)):
        if (spans[:, 1] - spans[:, 0]).max(initial=0) <= limit:
            return level
    return "none"


def cut_positions(points: np.ndarray, ends: tuple[np.ndarray, ...], limit: int, overlap: int, least: int) -> list[tuple[int, str]]:
    """Where each piece ends, and at what kind of boundary."""
    n, most, at, out = len(points), limit - overlap, 0, []
    if n <= limit:
        return [(n, "end")] if n else []
    h = landmark_hash(points)
    marks = np.flatnonzero(h % np.uint64(LANDMARK_EVERY) == 0) + 1
    while n - at > most:
        lo, hi = at + least, at + most
        a, b = np.searchsorted(marks, (lo, hi + 1))
        mark = int(marks[b - 1]) if b > a else lo + int(h[lo - 1 : hi].argmin())
        place, kind = mark, "none"
        for level, e in zip(LEVELS, ends):
            i, j = np.searchsorted(e, (lo, hi + 1))
            if j > i:
                near = e[i:j]
                place, kind = int(near[np.abs(near - mark).argmin()]), level
                break
        out.append((place, kind))
        at = place
    return [*out, (n, "end")]


def split_oversized(df: DataFrame, id_col: str, text_col: str, limit: int = 1400, overlap: int = 220, least: int = 500) -> DataFrame:
    """``item_id, cut_level, seq, start_pos, end_pos, cut, piece``: the pieces of every text over ``limit`` characters.

    ``cut_level``: the coarsest boundary at which all of the text could be cut; ``cut``: the one this piece ends at.
    """
    if not 0 <= overlap < limit or not 0 < least <= limit - overlap:
        raise ValueError("0 <= overlap < limit and 0 < least <= limit - overlap must hold")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["item_id", "cut_level", "seq", "start_pos", "end_pos", "cut", "piece"]
        for batch in batches:
            cols: list[list] = [[] for _ in names]
            size = 0
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                paras, sents, words, points = boundaries(text)
                level, begin = cut_level(paras, sents, words, limit), 0
                for seq, (end, kind) in enumerate(cut_positions(points, (paras[:, 1], sents[:, 1], words[:, 1]), limit, overlap, least)):
                    for col, value in zip(cols, (item, level, seq, begin, end, kind, text[begin:end])):
                        col.append(value)
                    size += end - begin
                    begin = end - overlap
                if size > 4_000_000:
                    yield _batch(names, cols)
                    cols, size = [[] for _ in names], 0
            yield _batch(names, cols)

    rows = df.where(F.col(id_col).isNotNull() & (F.char_length(text_col) > limit)).select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(cut, "item_id long, cut_level string, seq int, start_pos int, end_pos int, cut string, piece string")


def _batch(names: list[str], cols: list[list]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)
