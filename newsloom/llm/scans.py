"""Readable paragraphs from the text of scanned pages (problem 4).

Three things are found and undone:

* what each line is - a page's number, a running heading, a break (the first line of a paragraph) or
  body that goes on - by a linear-chain conditional model over the lines of a text: layout features
  give each line its scores, transitions tie neighbours, Viterbi decoding picks the best labelling.
  The model is trained here, as a chain, on at most ``4 * TRAIN_DOCS`` texts of which those without page
  marks are typeset into pages with known marks, under headings made of the texts' own words;
  paragraphs are put together by its breaks;
* words cut by a line's end, told from compounds by how the whole corpus writes them;
* misread words, by a noisy channel: undoing one of the known confusions of characters must lead
  to a word the corpus knows far better or whose letters are far likelier.

Word counts and letter statistics cover all texts. Words are judged once each, as rows of the
corpus' vocabulary; texts learn of the misread ones through a bit map of fixed size and an exact
join of the few words it lets through.

Defined results: null and empty texts have no lines; a text of one line has no running lines; equal
texts under different ids are treated alike; characters that are not letters are kept as they are.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.llm.tokens import local_copy, publish
from newsloom.session import shared_object, staged

TRAIN_DOCS = 300
#: Bits of the map of misread words.
MAP_BITS = 26
#: Letters of the grams that tell likely words from unlikely ones.
GRAM = 4
#: Share of all grams under which one says nothing (the score adds 0.05e-6 to each share).
LEAST_SHARE = 1e-8

#: Characters and what a scan makes of them.
CONFUSIONS = (
    ("e", "c"), ("t", "f"), ("i", "1"), ("a", "@"), ("n", "ri"), ("o", "0"), ("d", "cl"), ("s", "5"), ("l", "1"), ("u", "ii"), ("m", "rn"), ("g", "q"),
    ("w", "vv"), ("b", "6"), ("h", "li"), ("rn", "m"), ("cl", "d"), ("fi", "ﬁ"), ("fl", "ﬂ"), ("O", "0"), ("I", "1"), ("S", "5"), ("B", "8"), ("l", "I"), ("i", "l"), ("l", "|"),
)
HYPHENS = "-¬­‐‑"
_EDGES = ".,;:?!“”\"()[]‘’'«»"
_PAGE = re.compile(r"^\s*(?P<a>page\s+|pg?\.\s*|[-–—]\s*|\[\s*)?(?P<n>[\dlIO]{1,4})(?P<of>\s+of\s+[\dlIO]{1,4})?(?P<z>\s*[-–—]|\s*\]|\.)?\s*$", re.I)
_NUMBERED = re.compile(r"^\s*(?:(?P<n1>[\dlIO]{1,4})\s{2,}(?P<h1>\S.*?)|(?P<h2>\S.*?)\s{2,}(?P<n2>[\dlIO]{1,4}))\s*$")
_BROKEN = re.compile(rf"(\S*[^\W\d_])[{HYPHENS}]\s*$")
_CUT = re.compile(rf"(\S*[^\W\d_][{HYPHENS}])[^\S\n]*(?:\n\s*(?=(\S+))|\s*\Z)")
LABELS = ("body", "break", "running_line", "page_number")
PAGE_MARKS = ("running_line", "page_number")


# -- lines of the page ----------------------------------------------------------------------------
def page_value(text: str) -> int | None:
    text = re.sub("[lI]", "1", text).replace("O", "0")
    return int(text) if text.isdigit() else None


def _has(lines: pa.Array, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(lines, pattern).to_numpy(zero_copy_only=False)


def _count(lines: pa.Array, pattern: str) -> np.ndarray:
    return pc.count_substring_regex(lines, pattern).to_numpy(zero_copy_only=False)


def _alike(key: pa.Array) -> pa.Array:
    """Headings that a scan may have read a little differently, in one form: confusable characters are one."""
    for right, wrong in CONFUSIONS:
        if right.islower() and wrong.isascii() and wrong.isalpha() and wrong.islower() and len(wrong) >= len(right):
            key = pc.replace_substring(key, wrong, right)
    return key


def _times(doc: np.ndarray, key: pa.Array) -> np.ndarray:
    """How often each line's key stands in its text."""
    code = pd.factorize(key.to_numpy(zero_copy_only=False))[0].astype(np.int64)
    _, at, n = np.unique(doc * (code.max(initial=0) + 1) + code, return_inverse=True, return_counts=True)
    return n[at]


class Lines:
    """The lines of some texts that say something: their text, their number in it, and a row of layout features each.

    Blank lines and form feeds only mark gaps.
    """

    def __init__(self, texts: list[str]):
        split = [t.split("\n") for t in texts]
        size = np.fromiter(map(len, split), np.int64, len(split))
        flat = pa.array(list(chain.from_iterable(split)), pa.string())
        doc = np.repeat(np.arange(len(split)), size)
        no = np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size)
        left = np.repeat(size, size) - 1 - no
        bare = pc.utf8_trim_whitespace(flat)
        full, feed = pc.utf8_length(bare).to_numpy() > 0, _has(flat, "\x0c")

        def near(flag: np.ndarray, by: int) -> np.ndarray:
            """The flag of the line so many lines on, false beyond the text."""
            out = np.zeros(len(flag), bool)
            if by < 0:
                out[-by:] = flag[:by]
                return out & (no >= -by)
            out[:-by] = flag[by:]
            return out & (left >= by)

        gap, next_gap = near(~full, -1), near(~full, 1)
        after_feed = feed | near(feed, -1) | (gap & near(feed, -2))
        feed_next = near(feed, 1) | near(feed, 2)
        keep = np.flatnonzero(full)
        self.texts, self.doc, self.no = len(texts), doc[keep], no[keep]
        self.bare = bare.take(pa.array(keep))
        self.raw = pc.utf8_trim(flat.take(pa.array(keep)), "\x0c\r\n")
        self.features = self._features(gap[keep], next_gap[keep], after_feed[keep], feed_next[keep])

    def _features(self, gap: np.ndarray, next_gap: np.ndarray, feed: np.ndarray, feed_next: np.ndarray) -> np.ndarray:
        t, doc, n = self.bare, self.doc, len(self.doc)
        if not n:
            return np.zeros((0, N_FEATURES))
        starts = np.r_[0, np.flatnonzero(np.diff(doc)) + 1]
        first, last = np.zeros(n, bool), np.zeros(n, bool)
        first[starts], last[np.r_[starts[1:], n] - 1] = True, True
        before = lambda x: np.r_[False, x[:-1]] & ~first
        behind = lambda x: np.r_[x[1:], False] & ~last
        # Few lines look like a page's number or carry one; those are read one by one.
        page, numbered, framed, value = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, bool), np.full(n, -1)
        plain_page, head = np.zeros(n, bool), {}
        for i in np.flatnonzero(_has(t, r"(?i)^(page\s+|pg?\.\s*|[-–—]\s*|\[\s*)?[\dlIO]{1,4}(\s+of\s+[\dlIO]{1,4})?(\s*[-–—]|\s*\]|\.)?$") | _has(t, r"^[\dlIO]{1,4}\s{2,}\S|\S\s{2,}[\dlIO]{1,4}$")):
            line = t[i].as_py()
            m, h = _PAGE.match(line), _NUMBERED.match(line)
            v = page_value(m["n"]) if m else None
            if v is not None:
                page[i], framed[i], plain_page[i], value[i] = True, bool(m["a"] or m["z"]), not m["a"], v
            elif h:
                numbered[i], head[i] = True, h["h1"] or h["h2"]
                value[i] = -1 if (v := page_value(h["n1"] or h["n2"])) is None else v
        small = page & (value < 1500)
        # Numbers that go on by one from page to page.
        chained = (value >= 0) & ~_has(t, ",")
        later, earlier = np.zeros(n, bool), np.zeros(n, bool)
        at = np.flatnonzero(chained)
        if len(at):
            code = doc[at] * 20_000 + value[at]
            uniq, where = np.unique(code, return_inverse=True)
            high, low = np.full(len(uniq), -1), np.full(len(uniq), n)
            np.maximum.at(high, where, at)
            np.minimum.at(low, where, at)
            for flag, step, reach, test in ((later, 1, high, np.greater), (earlier, -1, low, np.less)):
                spot = np.minimum(np.searchsorted(uniq, code + step), len(uniq) - 1)
                flag[at] = (uniq[spot] == code + step) & test(reach[spot], at)
        length = pc.utf8_length(t).to_numpy()
        order = np.lexsort((length, doc))
        many = np.diff(np.r_[starts, n])
        width = np.maximum(length[order][starts + ((many - 1) * 0.9).astype(int)], 20)[np.searchsorted(starts, np.arange(n), "right") - 1]
        key = t
        if head:
            mark = np.zeros(n, bool)
            mark[list(head)] = True
            key = pc.replace_with_mask(t, pa.array(mark), pa.array([head[i] for i in sorted(head)], pa.string()))
        key = pc.utf8_trim_whitespace(pc.replace_substring_regex(pc.utf8_lower(key), "[^a-z]+", " "))
        said = (pc.utf8_length(key).to_numpy() > 0) & ~page
        stops, full_stop = _has(t, r"[.?!,;]$"), _has(t, r"[.?!”\"]$")
        repeated = said & (_times(doc, key) > 1)
        some = np.flatnonzero(said & (length > 5) & (length < 90) & (numbered | ~stops))
        repeated[some] |= _times(doc[some], _alike(key.take(pa.array(some)))) > 1
        letters, words, caps = _count(t, r"\p{L}"), _count(t, r"\p{L}+"), _count(t, r"(?:^|[^\p{L}])\p{Lu}")
        lower, upper = _has(t, r"^\p{Ll}"), _has(t, r"^\p{Lu}")
        open_before = before(~full_stop & ~page)
        lower_next = behind(lower)
        by_page = before(small) | behind(small)
        bent = pc.utf8_length(self.raw).to_numpy() != length
        mostly = lambda part: caps >= part * np.maximum(words, 1)
        ended = before(full_stop)
        short_before = before(length < 0.75 * width)
        marked = before(page | numbered | (repeated & ~stops))
        columns = [
            np.ones(n, bool), page, small, page & framed, page & (later | earlier), page & later & earlier, page & last, page & gap & next_gap, page & ~gap,
            page & bent, page & (feed_next | feed), page & (value >= 1500) & (value < 2100) & plain_page, numbered, numbered & (later | earlier), ~page & _has(self.raw, "^     "),
            (words > 0) & ~_has(t, r"\p{Ll}"), mostly(0.6) & (words > 1), full_stop, _has(t, rf"[,;:{HYPHENS}]$"), length < 0.75 * width, length / width, repeated, by_page & ~page,
            feed & ~page, open_before, lower_next, gap, next_gap, gap & next_gap, first, last, letters < 0.5 * length, _has(t, r"(?i)^(total|form)\b.*\d"),
            open_before & lower_next & ~stops & ~page & upper, repeated & mostly(0.5), (numbered | repeated | by_page) & ~stops, ~page & _has(t, r"^[^\p{L}]*\p{Ll}"), _count(t, ",") / 2, _has(t, " - "),
            ~page & (by_page | feed | feed_next), numbered & ~stops & mostly(0.4), ended, gap & ended, gap & ~ended, gap & lower, gap & upper & ended, short_before, gap & short_before, marked, marked & gap, marked & ended & upper,
        ]
        return np.stack([np.asarray(c, np.float64) for c in columns], axis=1)

    def sequences(self, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of lines of texts of about one length, padded with -1, and the texts' numbers of lines."""
        starts = np.r_[0, np.flatnonzero(np.diff(self.doc)) + 1] if len(self.doc) else np.zeros(0, np.int64)
        size = np.diff(np.r_[starts, len(self.doc)])
        order = np.argsort(size, kind="stable")
        lo = 0
        while lo < len(order):
            hi = lo + 1
            while hi < len(order) and (hi + 1 - lo) * size[order[hi]] <= most:
                hi += 1
            some, longest = order[lo:hi], size[order[hi - 1]]
            rows = starts[some][:, None] + np.arange(longest)
            yield np.where(np.arange(longest) < size[some][:, None], rows, -1), size[some]
            lo = hi


N_FEATURES = 51


class LineModel:
    """A linear-chain conditional model: weights of the features for each label, and of label pairs."""

    def __init__(self, weights: np.ndarray, pairs: np.ndarray):
        self.weights, self.pairs = weights, pairs

    @classmethod
    def train(cls, texts: list[tuple[list[str], dict[int, str]]], rounds: int = 30, ridge: float = 0.3) -> LineModel:
        """Greatest likelihood of whole labellings: forward-backward expectations, steps of limited-memory quasi-Newton."""
        lines = Lines(["\n".join(x) for x, _ in texts])
        y = np.array([LABELS.index(texts[d][1].get(i, "body")) for d, i in zip(lines.doc.tolist(), lines.no.tolist())], np.int64)
        x, k = lines.features, len(LABELS)
        batches = [(rows, np.where(rows >= 0, y[rows], 0)) for rows, _ in lines.sequences(1 << 14)]
        seen, pair_seen = np.zeros((x.shape[1], k)), np.zeros((k, k))
        np.add.at(seen.T, y, x)
        for rows, gold in batches:
            both = rows[:, 1:] >= 0
            np.add.at(pair_seen, (gold[:, :-1][both], gold[:, 1:][both]), 1)

        def loss(theta: np.ndarray) -> tuple[float, np.ndarray]:
            w, pairs = theta[: seen.size].reshape(seen.shape), theta[seen.size :].reshape(k, k)
            score, total = x @ w, ridge / 2 * float(theta @ theta)
            chance, pair_chance = np.zeros((len(x), k)), np.zeros((k, k))
            for rows, gold in batches:
                n, span = rows.shape
                s, here = score[rows], rows >= 0
                ahead = np.zeros((span, n, k))
                ahead[0] = s[:, 0]
                for i in range(1, span):
                    step = _log_sum(ahead[i - 1][:, :, None] + pairs[None], 1) + s[:, i]
                    ahead[i] = np.where(here[:, i, None], step, ahead[i - 1])
                back, log_z = np.zeros((n, k)), _log_sum(ahead[-1], 1)
                total += float(log_z.sum()) - float(s[here][np.arange(here.sum()), gold[here]].sum()) - float(pairs[gold[:, :-1], gold[:, 1:]][here[:, 1:]].sum())
                for i in range(span - 1, -1, -1):
                    p = np.exp(ahead[i] + back - log_z[:, None])
                    chance[rows[here[:, i], i]] = p[here[:, i]]
                    if i:
                        tail = s[:, i] + back
                        both = ahead[i - 1][:, :, None] + pairs[None] + tail[:, None, :] - log_z[:, None, None]
                        pair_chance += np.exp(both[here[:, i]]).sum(axis=0)
                        back = np.where(here[:, i, None], _log_sum(pairs[None] + tail[:, None, :], 2), back)
            grad = np.r_[(x.T @ chance - seen).ravel(), (pair_chance - pair_seen).ravel()] + ridge * theta
            return total, grad

        theta = _minimised(loss, np.zeros(seen.size + k * k), rounds)
        return cls(theta[: seen.size].reshape(seen.shape), theta[seen.size :].reshape(k, k))

    def label_texts(self, texts: list[str]) -> list[dict[int, str]]:
        """Labels of each text's lines that aren't plain body, by line number from 0."""
        lines = Lines(texts)
        out: list[dict[int, str]] = [{} for _ in texts]
        score = lines.features @ self.weights
        state = np.zeros(len(score), np.int64)
        for rows, size in lines.sequences():
            s, span = score[rows], rows.shape[1]
            best, came = s[:, 0], np.zeros((span, len(rows), len(LABELS)), np.int8)
            for i in range(1, span):
                way = best[:, :, None] + self.pairs[None]
                came[i] = way.argmax(axis=1)
                best = np.where((i < size)[:, None], way.max(axis=1) + s[:, i], best)
            at = best.argmax(axis=1)
            for i in range(span - 1, -1, -1):
                here = i < size
                state[rows[here, i]] = at[here]
                at = np.where(here, came[i][np.arange(len(rows)), at], at)
        marked = np.flatnonzero(state)
        for d, no, x in zip(lines.doc[marked].tolist(), lines.no[marked].tolist(), state[marked].tolist()):
            out[d][no] = LABELS[x]
        return out

    def label(self, lines: list[str]) -> dict[int, str]:
        return self.label_texts(["\n".join(lines)])[0]


def _log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return np.log(np.exp(a - top).sum(axis=axis)) + top.squeeze(axis)


def _minimised(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], at: np.ndarray, rounds: int, memory: int = 10) -> np.ndarray:
    """The point of least loss, by limited-memory quasi-Newton steps with halving."""
    value, grad = loss(at)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        way, used = grad.copy(), []
        for s, y in reversed(steps):
            used.append(s @ way / (s @ y))
            way -= used[-1] * y
        way *= steps[-1][0] @ steps[-1][1] / (steps[-1][1] @ steps[-1][1]) if steps else 1 / max(np.abs(grad).sum(), 1e-9)
        for (s, y), a in zip(steps, reversed(used)):
            way += (a - y @ way / (s @ y)) * s
        size = 1.0
        while size > 1e-6:
            there = at - size * way
            new, slope = loss(there)
            if new <= value - 1e-4 * size * (grad @ way):
                break
            size /= 2
        else:
            break
        s, y = there - at, slope - grad
        if s @ y > 1e-10:
            steps = [*steps[1 - memory :], (s, y)]
        done = value - new < 1e-5 * abs(value)
        at, value, grad = there, new, slope
        if done:
            break
    return at


def looks_unpaged(text: str) -> bool:
    """No form feeds, numbered headings or lines that look like a page's number."""
    lines = text.split("\n")
    return "\x0c" not in text and not any(_NUMBERED.match(x) and len(x.strip()) > 8 for x in lines) and not any((m := _PAGE.match(x)) and (page_value(m["n"]) or 0) < 1500 for x in lines)


def paragraph_starts(lines: list[str]) -> set[int]:
    """Where the paragraphs of an unpaged text begin: after blank lines that don't cut a sentence."""
    out, before, gap = set(), "", True
    for no, line in enumerate(lines):
        bare = line.strip()
        if not bare:
            gap = True
            continue
        if gap and not (before and before[-1] not in ".?!:”\"" and bare[0].islower()):
            out.add(no)
        before, gap = bare, False
    return out


def typeset(text: str, heading: str, rng: np.random.Generator) -> tuple[list[str], dict[int, str]]:
    """A text set into pages with numbers and headings in one of the usual styles, and their labels."""
    body = text.split("\n")
    starts = paragraph_starts(body)
    height, page = int(rng.integers(14, 34)), int(rng.integers(1, 45))
    style, head_style, wide = int(rng.integers(0, 8)), int(rng.integers(0, 8)), max(map(len, body), default=60)
    feed, numbers, heads, loose = rng.random() < 0.3, rng.random() < 0.85, rng.random() < 0.7, rng.random() < 0.3
    upper, often = rng.random() < 0.5, rng.choice([0.3, 0.6, 0.95])
    out: list[str] = []
    truth: dict[int, str] = {}

    def add(line: str, label: str) -> None:
        truth[len(out)] = label
        out.append(line)

    def digits(v: int) -> str:
        return str(v).replace("1", "l") if rng.random() < 0.06 else str(v)

    at = 0
    while at < len(body):
        if at and heads and rng.random() < often:
            name = heading.upper() if upper else heading
            if rng.random() < 0.1:
                right, wrong = CONFUSIONS[int(rng.integers(0, len(CONFUSIONS)))]
                name = name.replace(right, wrong, 1)
            if head_style > 3 and numbers:
                name = f"{digits(page)}    {name}" if page % 2 else f"{name}    {digits(page)}"
            elif head_style in (1, 2):
                name = " " * max(0, (wide - len(name)) // 2) + name
            if rng.random() < 0.2:
                out.append("")
            add(name, "running_line")
            if rng.random() < 0.3:
                out.append("")
        for no in range(at, min(at + height, len(body))):
            if no in starts:
                add(body[no], "break")
                continue
            if loose and body[no].strip() and rng.random() < 0.03:
                out.append("")
            out.append(body[no])
        at += height
        if numbers and not (heads and head_style > 3):
            v = digits(page)
            if rng.random() < 0.35:
                out.append("")
            line = (f"Page {v}", f"Page {v} of {page + 9}", f"- {v} -", f"[{v}]", f"p. {v}", v, v + "  ", " " * (wide - 3) + v)[style]
            add(" " * (wide - 4) + line if style == 4 and upper else line, "page_number")
        if feed and at < len(body):
            out.append("\x0c")
        page += 1
    return out, truth


def heading_of(text: str, rng: np.random.Generator) -> str:
    """A heading made of a text's own words: some of them as a title, with a name or a year at times."""
    words = re.findall(r"[^\W\d_]{3,}", text) or ["Record", "Report"]
    title = [str(w) for w in rng.choice(words, int(rng.integers(1, 6)))]
    plain = " ".join(title).lower().capitalize()
    title = " ".join(w.capitalize() if i == 0 or rng.random() < 0.8 else w.lower() for i, w in enumerate(title))
    names = re.findall(r"[A-Z][a-z]+(?: [A-Z][a-z]+){1,4}", text) or [title]
    name = max(rng.choice(names, 3), key=len) if rng.random() < 0.7 else rng.choice(names)
    kind = rng.random()
    if kind < 0.3:
        return f"{name} - {title}"
    if kind < 0.45:
        return str(name)
    if kind < 0.6:
        return f"{title} {rng.integers(1990, 2030)}" + (" " + title.split()[0] if kind < 0.52 else "")
    if kind < 0.7:
        return f"{title} {rng.choice(['January', 'June', 'September'])} {rng.integers(1, 29)}, {rng.integers(1990, 2030)}"
    return plain if kind < 0.85 else title


_SPARE = "The committee reviewed the filing and restated the reserve before the fiscal year closed, as part of a broader plan."


def train_model(texts: list[str], seed: int = 5) -> LineModel:
    """The model trained on unpaged texts set into pages; a stock paragraph stands in where there are none."""
    rng = np.random.default_rng(seed)
    plain = [t for t in texts if looks_unpaged(t)] or ["\n".join([_SPARE[:60], _SPARE[60:], "", "Total  $4,120", ""] * 12)]
    made = []
    for i in range(2 * TRAIN_DOCS):
        text = plain[i % len(plain)]
        lines = text.split("\n")
        made.append(typeset(text, heading_of(text, rng), rng) if i % 5 else (lines, dict.fromkeys(paragraph_starts(lines), "break")))
    return LineModel.train(made)


# -- words ----------------------------------------------------------------------------------------
def bare_word(token: str) -> str:
    return token.strip(_EDGES)


def count_tokens(text: str, total: Counter) -> None:
    """Counts the tokens of a text but for those at a line's broken end and what continues them."""
    total.update(text.split())
    out = {}
    for m in _CUT.finditer(text):
        out[m.start(1)] = m[1]
        if m[2]:
            out[m.start(2)] = m[2]
    total.subtract(out.values())


def vocabulary(df: DataFrame) -> DataFrame:
    """``word, n`` over all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                count_tokens(text, total)
                if len(total) > 400_000:
                    yield _counts(total)
        yield _counts(total)

    return df.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _counts(total: Counter) -> pa.RecordBatch:
    """The words of counted tokens: what stands at a token's edges goes only now, once a token."""
    words: Counter = Counter()
    for token, n in total.items():
        if n and (w := bare_word(token)):
            words[w] += n
    total.clear()
    return pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], ["word", "n"])


def grams(word: str) -> list[str]:
    s = "^^^" + word.lower() + "$"
    return [s[i : i + GRAM] for i in range(len(s) - GRAM + 1)]


class Letters:
    """How likely a word's letters are, from the grams of the corpus' words.

    Grams count by their share of all, so more rows of the same words change no likelihood.
    """

    def __init__(self, counts: dict[str, int]):
        self.counts, self.heads = counts, Counter()
        for g, n in counts.items():
            self.heads[g[:-1]] += n
        self.all = sum(counts.values()) or 1

    def gain(self, word: str, meant: str, without: dict[str, int]) -> float:
        """How much likelier ``meant`` is than ``word``, by the corpus without some words that occur so often."""
        less, less_heads = Counter(), Counter()
        for w, n in without.items():
            if w.isalpha():
                for g in grams(w):
                    less[g] += n
                    less_heads[g[:-1]] += n

        def share(of: dict[str, int], out: Counter, g: str) -> float:
            return max(of.get(g, 0) - out[g], 0) / self.all

        def score(w: str) -> float:
            return sum(math.log((share(self.counts, less, g) + 0.05e-6) / (share(self.heads, less_heads, g[:-1]) + 2e-6)) for g in grams(w))

        return score(meant) - score(word)


def readings(word: str) -> set[str]:
    """The words of which this may be a misreading: one confusion undone, at one place or at all."""
    out = set()
    for right, wrong in CONFUSIONS:
        at = word.find(wrong)
        while at >= 0:
            out.add(word[:at] + right + word[at + len(wrong) :])
            at = word.find(wrong, at + 1)
        if word.count(wrong) > 1:
            out.add(word.replace(wrong, right))
    out.discard(word)
    return {w for w in out if all(c.isalpha() or c in "-’'" for c in w)}


def misread_words(spark: SparkSession, words: DataFrame) -> DataFrame:
    """``word, meant``: the misread words of a vocabulary (``word, n``) and what they stand for.

    Decided by ratios of counts and shares of grams only, so the number of rows doesn't matter.
    """

    def gram_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for pdf in batches:
            for w, n in zip(pdf["word"], pdf["n"]):
                if w.isalpha():
                    for g in grams(w):
                        total[g] += int(n)
        if total:
            yield pd.DataFrame({"g": list(total), "n": list(total.values())})

    # Grams of letters are bounded by the alphabet; those of a share that can't weigh in a score are left out,
    # so there are at most 1 / LEAST_SHARE of them, whatever the corpus and the alphabet.
    counted = staged(spark, words.mapInPandas(gram_counts, "g string, n long").groupBy("g").agg(F.sum("n").alias("n")), "grams")
    total = counted.agg(F.sum("n")).first()[0] or 0
    counted = counted.where(F.col("n") >= total * LEAST_SHARE).toPandas()
    letters = shared_object(spark, Letters(dict(zip(counted["g"], counted["n"].astype(int)))))

    def candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for w, n, own in zip(pdf["word"], pdf["n"], pdf["own"]):
                if sum(c.isalpha() for c in w) < 3 or not re.fullmatch(r"[\w@|’'\-ﬁﬂ]+", w):
                    continue
                odd = any(c in "@|ﬁﬂ" or c.isdigit() for c in w)
                rows += [(w, n, own, c, odd) for c in readings(w)]
            if rows:
                yield pd.DataFrame(rows, columns=["word", "n", "own", "meant", "odd"])

    def gains(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gain = letters().gain
        for pdf in batches:
            each = list(zip(pdf["word"], pdf["own"], pdf["meant"], pdf["theirs"]))
            # A word's own occurrences don't speak for its letters; ``fair`` leaves those of both out.
            alone = [gain(w, c, {w.lower(): own}) for w, own, c, _ in each]
            fair = [gain(w, c, {w.lower(): own, c.lower(): theirs}) for w, own, c, theirs in each]
            yield pdf[["word", "n", "meant", "m", "odd"]].assign(gain=alone, fair=fair)

    # All spellings of a word that differ by case have the same grams.
    spelt = words.select("word", "n", F.sum("n").over(Window.partitionBy(F.lower("word"))).alias("own"))
    known = spelt.select(F.col("word").alias("meant"), F.col("n").alias("m"), F.col("own").alias("theirs"))
    made = spelt.mapInPandas(candidates, "word string, n long, own long, meant string, odd boolean").join(known, "meant", "left")
    made = made.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("m", "theirs")}).where(F.col("odd") | (F.col("m") * 3 >= F.col("n")))
    judged = made.mapInPandas(gains, "word string, n long, meant string, m long, odd boolean, gain double, fair double")
    rare = (F.col("m") >= 30 * F.col("n")) & (F.col("gain") > 0)
    likelier = (F.col("m") >= 5 * F.col("n")) & (F.col("gain") > 4)
    far = (F.col("fair") > 8) & (F.col("m") * 3 >= F.col("n"))
    odd = F.col("odd") & ((F.col("m") > 0) | (F.col("gain") > 3))
    hit = judged.where(rare | likelier | far | odd)
    return hit.groupBy("word").agg(F.max_by("meant", F.struct(F.col("m"), F.col("gain"), F.col("meant"))).alias("meant"))


def publish_map(spark: SparkSession, words: DataFrame) -> str:
    """A bit map of fixed size with the hashes of the words."""
    block_bits = 16

    def bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for pdf in batches:
            for b, cell in zip(pdf["block"], pdf["cell"]):
                held.setdefault(b, np.zeros(1 << block_bits, bool))[cell] = True
        if held:
            yield pd.DataFrame([(b, np.packbits(v).tobytes()) for b, v in held.items()], columns=["block", "bits"])

    cell = F.pmod(F.xxhash64("word"), F.lit(1 << MAP_BITS))
    at = words.select((F.shiftright(cell, block_bits)).cast("int").alias("block"), (cell.bitwiseAND((1 << block_bits) - 1)).cast("int").alias("cell")).distinct()
    whole = np.zeros((1 << MAP_BITS) // 8, np.uint8)
    for r in at.repartition("block").mapInPandas(bits, "block int, bits binary").toLocalIterator():
        whole[r["block"] * (1 << block_bits) // 8 : (r["block"] + 1) * (1 << block_bits) // 8] |= np.frombuffer(r["bits"], np.uint8)
    return publish(spark, whole.tobytes(), "misread")


# -- texts ----------------------------------------------------------------------------------------
def broken_parts(lines: list[str], labels: dict[int, str]) -> list[tuple[int, str, str]]:
    """Body lines that end in a hyphen: line number from 0, the half word there and the one that follows."""
    out, body = [], [i for i, x in enumerate(lines) if labels.get(i) not in PAGE_MARKS and x.strip()]
    for i, nxt in zip(body, body[1:]):
        if (end := lines[i].rstrip())[-1] in HYPHENS and (m := _BROKEN.search(end)):
            follow = bare_word(lines[nxt].split()[0])
            if follow[:1].islower():
                out.append((i, m.group(1).lstrip(_EDGES), follow))
    return out


def page_noise(spark: SparkSession, df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """``doc_id, line_no, noise_kind, typed, meant`` of all noise and breaks (lines from 1), and the texts it was read from.

    ``typed, meant`` of a broken word are its halves, of a misread word what stands there and what is meant.
    """
    texts = df.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull() & (F.col(text_col) != "")).select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    sample = [r["text"] for r in texts.orderBy(F.xxhash64("doc_id"), "doc_id").limit(4 * TRAIN_DOCS).select("text").collect()]
    model = shared_object(spark, train_model(sample))
    words = staged(spark, vocabulary(texts), "vocabulary")
    misread = staged(spark, misread_words(spark, words), "misread")
    uri = publish_map(spark, misread)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        bits, lines_of = np.memmap(local_copy(uri), np.uint8, "r"), model()

        def suspected(word: str) -> bool:
            cell = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 42) & ((1 << MAP_BITS) - 1)
            return bool(bits[cell >> 3] >> (7 - (cell & 7)) & 1)

        told: dict[str, bool] = {}
        for pdf in batches:
            rows = []
            for lo in range(0, len(pdf), 500):
                docs, some = pdf["doc_id"].iloc[lo : lo + 500].tolist(), pdf["text"].iloc[lo : lo + 500].tolist()
                for doc, text, labels in zip(docs, some, lines_of.label_texts(some)):
                    lines = text.split("\n")
                    rows += [(doc, no + 1, kind, None, None) for no, kind in labels.items()]
                    rows += [(doc, no + 1, "broken_word", a, b) for no, a, b in broken_parts(lines, labels)]
                    # Each word is looked up once; a text is gone through by lines only if it has a suspected one.
                    words = {bare_word(t) for t in text.split()}
                    if len(told) > 1_000_000:
                        told.clear()
                    told.update((w, suspected(w)) for w in words if w not in told)
                    odd = {w for w in words if w and told[w]}
                    if odd:
                        rows += [(doc, no + 1, "misread", w, None) for no, line in enumerate(lines) if labels.get(no) not in PAGE_MARKS for w in odd & {bare_word(t) for t in line.split()}]
            if rows:
                yield pd.DataFrame(rows, columns=["doc_id", "line_no", "noise_kind", "typed", "rest"])

    noise = staged(spark, texts.mapInPandas(find, "doc_id string, line_no int, noise_kind string, typed string, rest string"), "noise")
    none = F.lit(None).cast("string")
    lines = noise.where(F.col("noise_kind").isin("page_number", "running_line", "break")).select("doc_id", "line_no", "noise_kind", none.alias("typed"), none.alias("meant"))
    # A compound keeps its hyphen if the corpus writes it with one more often than without.
    halves = noise.where("noise_kind = 'broken_word'").withColumn("joined", F.concat("typed", "rest")).withColumn("hyphened", F.concat_ws("-", "typed", "rest"))
    count = lambda name, n: words.select(F.lower("word").alias(name), "n").groupBy(name).agg(F.sum("n").alias(n))
    asked = halves.select("joined", "hyphened").distinct().withColumn("jl", F.lower("joined")).withColumn("hl", F.lower("hyphened"))
    asked = asked.join(count("jl", "nj"), "jl", "left").join(count("hl", "nh"), "hl", "left")
    compound = asked.where(F.coalesce("nh", F.lit(0)) > F.coalesce("nj", F.lit(0))).select("joined", "hyphened")
    broken = halves.join(compound, ["joined", "hyphened"], "left_anti").select("doc_id", "line_no", "noise_kind", "typed", F.col("rest").alias("meant"))
    wrong = noise.where("noise_kind = 'misread'").select("doc_id", "line_no", "noise_kind", "typed")
    wrong = wrong.join(misread.withColumnRenamed("word", "typed"), "typed").select("doc_id", "line_no", "noise_kind", "typed", "meant")
    return lines.unionByName(broken).unionByName(wrong), texts


def noise_lines(noise: DataFrame) -> DataFrame:
    """``doc_id, line_no, noise_kind``: one row a line and kind; breaks are no noise."""
    return noise.where("noise_kind <> 'break'").select("doc_id", "line_no", "noise_kind").distinct()


def readable_paragraphs(noise: DataFrame, texts: DataFrame) -> DataFrame:
    """``doc_id, paragraph_no, paragraph``: the texts without their page marks, words whole and corrected.

    A paragraph goes on, over pages too, until a line that the model calls a break.
    """
    marks = noise.groupBy("doc_id").agg(F.collect_list(F.struct("line_no", "noise_kind", "typed", "meant")).alias("marks"))

    def rebuild(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, text, marks_ in zip(pdf["doc_id"], pdf["text"], pdf["marks"]):
                rows += [(doc, no + 1, p) for no, p in enumerate(paragraphs_of(text, [] if marks_ is None else marks_))]
            if rows:
                yield pd.DataFrame(rows, columns=["doc_id", "paragraph_no", "paragraph"])

    return texts.join(marks, "doc_id", "left").mapInPandas(rebuild, "doc_id string, paragraph_no int, paragraph string")


def paragraphs_of(text: str, marks) -> list[str]:
    """The paragraphs of one text, given the marks of its noise."""
    page = {m["line_no"] for m in marks if m["noise_kind"] in PAGE_MARKS}
    breaks = {m["line_no"] for m in marks if m["noise_kind"] == "break"}
    broken = {m["line_no"] for m in marks if m["noise_kind"] == "broken_word"}
    fixes: dict[int, dict[str, str]] = {}
    for m in marks:
        if m["noise_kind"] == "misread":
            fixes.setdefault(m["line_no"], {})[m["typed"]] = m["meant"]
    out: list[str] = []
    part, join = "", False
    for no, line in enumerate(text.split("\n"), 1):
        body = line.strip()
        if not body or no in page:
            continue
        tokens = body.split()
        for i, t in enumerate(tokens):
            w = bare_word(t)
            if w in fixes.get(no, {}):
                tokens[i] = t.replace(w, fixes[no][w])
        body = " ".join(tokens)
        if part and (join or no not in breaks):
            part = part + ("" if join or part.endswith("-") else " ") + body
        else:
            if part:
                out.append(part)
            part = body
        join = no in broken
        if join:
            part = re.sub(rf"[{HYPHENS}]\s*$", "", part)
    return [*out, part] if part else out
