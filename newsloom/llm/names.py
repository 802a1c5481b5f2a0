"""Which organisation of a roster a typed name means, or none (problem 3).

Names are folded to tokens. A symmetric-delete index over the roster's tokens - every token with
each one of its characters left out - finds the roster tokens within one edit of a typed one
without comparing them all; prefixes and consonants find those it may abbreviate. Candidates that share
a token are then aligned token by token by an optimal assignment that allows edits, initials and
abbreviations of any word; a name means an organisation if all it says is said by that organisation and
by no other.

Which words are generic - the kind of organisation, the lie of the land - is learned from the roster:
those in at least ``GENERIC_SHARE`` of its rows. They are abbreviated more freely, and nothing is found
by them alone while a name says more. A roster too small to show it has no generic words.

The roster is a dimension table of checked size
(``MAX_ROSTER`` rows); its index is built once and broadcast. The typed names, which grow, are
reduced to distinct spellings, resolved where they lie and joined back.

Defined results: null, empty and blank names mean none, as do names that several organisations
fit equally well; an empty roster gives no rows; repeated rows get repeated results.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.session import shared_object

MAX_ROSTER = 200_000

#: Words around a name that don't belong to it.
NOISE = frozenset("the of and for friends trustees inc incorporated llc ltd corp corporation licensee affiliates affiliate company board governors assn".split())
#: Common short forms that aren't plain abbreviations of the word meant.
SHORT_FORMS = {
    "tv": "television", "harbour": "harbor", "bcasting": "broadcasting", "bcstg": "broadcasting", "bcast": "broadcast", "co": "county", "cty": "county",
    "ed": "educational", "comm": "community", "cmty": "community", "net": "network", "med": "media", "is": "island", "val": "valley",
    "st": "saint", "mt": "mount", "ft": "fort",
}
#: Rows, and share of all rows, that hold a word which is generic.
GENERIC_ROWS, GENERIC_SHARE = 8, 0.01
#: A word that abbreviates a generic one this many times as frequent is that word's short form, not a word.
SHORT_RATIO = 5
_CALL = re.compile(r"^[kw][b-df-hj-np-tv-z]{3,4}$")
_BANDS = {"fm": "radio", "am": "radio", "tv": "television"}


def fold(name: str) -> list[str]:
    """Tokens of a name: no case, accents, apostrophes or punctuation; dotted letters are one token."""
    s = "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c)).lower()
    s = re.sub(r"['’`´]", "", s)
    s = re.sub(r"\b(?:[a-z]\.){2,}(?:[a-z]\b)?", lambda m: m.group().replace(".", "") + " ", s)
    return re.findall(r"[^\W_]+", s)


def edits(a: str, b: str) -> int:
    """Edit distance with adjacent swaps, 2 standing for two or more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > 1:
        return 2
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        if a[i + 1 :] == b[i + 1 :]:
            return 1
        return 1 if a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :] else 2
    short, long_ = sorted((a, b), key=len)
    return 1 if short[i:] == long_[i + 1 :] else 2


def deletes(token: str) -> set[str]:
    """The token and all it becomes with one character left out."""
    return {token, *(token[:i] + token[i + 1 :] for i in range(len(token)))}


def abbreviates(short: str, word: str) -> bool:
    """``short`` begins like ``word`` and is made of its letters in order; its long form may be fixed."""
    if SHORT_FORMS.get(short) == word:
        return True
    if not 2 <= len(short) < len(word) or short[0] != word[0] or short in SHORT_FORMS:
        return False
    rest = iter(word)
    return all(c in rest for c in short)


def curt(short: str, word: str) -> bool:
    """The narrower rule for words that tell organisations apart: a beginning, or without the vowels inside, and clearly shorter."""
    if SHORT_FORMS.get(short) == word:
        return True
    if not 3 <= len(short) <= len(word) - 2 or short in SHORT_FORMS:
        return False
    return word.startswith(short) or (not set(short[1:-1]) & set("aeiou") and abbreviates(short, word))


class Words:
    """The generic words of a roster, those of them that only follow a place, and what a spelling costs."""

    def __init__(self, names: Iterable[list[str]]):
        names = list(names)
        rows: Counter = Counter()
        for tokens in names:
            rows.update(set(tokens))
        least = max(GENERIC_ROWS, GENERIC_SHARE * len(names))
        often = {t: n for t, n in rows.items() if n >= least}
        self.common = frozenset(t for t, n in often.items() if not any(m >= SHORT_RATIO * n and abbreviates(t, w) for w, m in often.items() if w != t))
        # The lie of the land stands between a place's name and the kind of organisation.
        after, last = Counter(), Counter()
        for tokens in names:
            for i, t in enumerate(tokens):
                after[t] += i > 0 and tokens[i - 1] not in self.common
                last[t] += i == len(tokens) - 1
        self.features = frozenset(t for t in self.common if after[t] >= 0.8 * rows[t] and last[t] <= 0.2 * rows[t])
        self.costs: dict[tuple[str, str], float] = {}

    def cost(self, typed: str, word: str) -> float:
        """0 for equal, below 1 for a slip, an abbreviation or an initial, infinite for different words."""
        cost = self.costs.get((typed, word))
        if cost is None:
            if len(self.costs) > 300_000:
                self.costs.clear()
            cost = self.costs[typed, word] = self._cost(typed, word)
        return cost

    def _cost(self, typed: str, word: str) -> float:
        if typed == word:
            return 0.0
        if word in self.common:
            if abbreviates(typed, word):
                return 0.1
            return 0.3 if typed not in self.common and len(typed) >= 4 and edits(typed, word) == 1 else float("inf")
        if len(word) >= 4 and edits(typed, word) == 1:
            return 0.4
        if typed in self.common:
            return float("inf")
        if curt(typed, word) or SHORT_FORMS.get(word) == typed:
            return 0.5
        return 0.7 if len(typed) == 1 and word[0] == typed and len(word) > 3 else float("inf")


def align(typed: list[str], words: list[str], cost_of: Callable[[str, str], float]) -> tuple[float, int]:
    """Least total cost of giving each typed token its own word, and the mask of words used; infinite if one has none."""
    best = {0: 0.0}
    for t in typed:
        step: dict[int, float] = {}
        for used, cost in best.items():
            for j, w in enumerate(words):
                if not used >> j & 1:
                    c = cost + cost_of(t, w)
                    if c < step.get(used | 1 << j, float("inf")):
                        step[used | 1 << j] = c
        best = step
        if not best:
            return float("inf"), 0
    used = min(best, key=lambda m: (best[m], m))
    return best[used], used


class Typed:
    """What a typed name says: call signs, the band written after one, and the other tokens in order."""

    def __init__(self, name: str | None):
        raw = fold(name or "")
        self.calls = [t for t in raw if _CALL.match(t)]
        tokens, self.band = [], None
        for i, t in enumerate(raw):
            if t in self.calls or t in NOISE:
                continue
            if t in _BANDS and (t != "tv" or (i and raw[i - 1] in self.calls)):
                self.band = t
                continue
            tokens.append(t)
        self.tokens = tokens
        self.the = bool(raw) and raw[0] == "the"


class Roster:
    """Organisations: their rows, names, call signs and on-air names, with the token index."""

    def __init__(self, rows: list[tuple[str, str, str | None, str | None]]):
        self.root = {r[0]: r[0] for r in rows}
        self.names: dict[str, list[list[str]]] = defaultdict(list)
        self.calls: dict[str, set[str]] = defaultdict(set)
        self.air: dict[tuple[str, ...], set[str]] = defaultdict(set)
        self.rows = sorted(rows)
        self.words = Words(Typed(r[1]).tokens for r in self.rows)
        self._notes()
        self._clean()
        self._index()
        self._merge()

    # -- building -----------------------------------------------------------------------------
    def find(self, sid: str) -> str:
        while self.root[sid] != sid:
            self.root[sid] = self.root[self.root[sid]]
            sid = self.root[sid]
        return sid

    def union(self, a: str, b: str) -> None:
        a, b = sorted((self.find(a), self.find(b)))
        self.root[b] = a

    def _notes(self) -> None:
        """Call signs and on-air names that the roster states for a row."""
        self.own_calls: dict[str, set[str]] = {}
        for sid, name, notes, _ in self.rows:
            calls = set(Typed(name).calls)
            said = re.sub(r"(?i)formerly listed under", "", notes or "")
            calls |= {c.lower() for c in re.findall(r"\b[KW][A-Z]{3,4}\b", said)}
            self.own_calls[sid] = calls
            for c in calls:
                self.calls[c].add(sid)
            m = re.search(r"(?i)(?:aka|branded|on air as)\s+(.+?)\s*(?:/|;|$)", notes or "")
            if m:
                self.air[tuple(t for t in fold(m.group(1)) if t not in NOISE)].add(sid)

    def _clean(self) -> None:
        """A row's name, its short words written out, and the place that its own address states."""
        self.place_of: dict[str, str] = {}
        for sid, name, _, url in self.rows:
            tokens = [self._long(t) for t in Typed(name).tokens]
            self.names[sid].append(tokens)
            host = re.match(r"(?i)https?://(?:www\.)?([a-z]+)(?:-[a-z-]+)?\.", url or "")
            places = [t for t in tokens if t not in self.words.common]
            if host and places and host.group(1) not in self.words.common and edits(host.group(1), places[0]) == 1:
                self.names[sid].append([host.group(1) if t == places[0] else t for t in tokens])

    def _long(self, token: str) -> str:
        """The generic word a token stands for, if there is one and no other."""
        if token in self.words.common or token in NOISE:
            return token
        fits = {w for w in self.words.common if self.words.cost(token, w) < 1}
        return fits.pop() if len(fits) == 1 else token

    def _index(self) -> None:
        """Symmetric deletes, beginnings and consonants of the words that tell organisations apart."""
        self.at: dict[str, set[str]] = defaultdict(set)
        self.near: dict[str, set[str]] = defaultdict(set)
        self.short: dict[str, set[str]] = defaultdict(set)
        self.initials: dict[str, set[str]] = defaultdict(set)
        #: Rows whose names are generic words only.
        self.plain: set[str] = set()
        for sid, variants in self.names.items():
            for tokens in variants:
                own = [t for t in tokens if t not in self.words.common]
                for t in own:
                    self.at[t].add(sid)
                    for d in deletes(t):
                        self.near[d].add(t)
                    for key in self._short_keys(t):
                        self.short[key].add(t)
                if tokens and not own:
                    self.plain.add(sid)
                if len(tokens) >= 3:
                    self.initials["".join(t[0] for t in tokens)].add(sid)

    @staticmethod
    def _short_keys(word: str) -> set[str]:
        """What a word's abbreviations are looked up by: each beginning, its first letter with each later one, a fixed long form."""
        return {word[:n] for n in range(3, len(word) - 1)} | {f"{word[0]}*{c}" for c in word[1:]} | {s for s, w in SHORT_FORMS.items() if w == word}

    def _merge(self) -> None:
        """Rows that are one organisation: one call sign, or names that say the same."""
        for sids in self.calls.values():
            first, *more = sorted(sids)
            for sid in more:
                if self._agree(first, sid):
                    self.union(first, sid)
        for sid, name, _, _ in self.rows:
            for typed in self.names[sid]:
                for other in sorted(self.candidates(typed)):
                    if other != sid and self.find(other) != self.find(sid) and self._same(typed, other):
                        self.union(sid, other)
        self.groups: dict[str, list[str]] = defaultdict(list)
        for sid in self.root:
            self.groups[self.find(sid)].append(sid)

    def _agree(self, a: str, b: str) -> bool:
        """No word of either contradicts the other (radio and television of one place do)."""
        kinds = [{t for v in self.names[s] for t in v} & {"radio", "television"} for s in (a, b)]
        return not (kinds[0] and kinds[1] and kinds[0].isdisjoint(kinds[1]))

    def _same(self, typed: list[str], other: str) -> bool:
        """Each word of one name has its word in the other; a feature may be missing on one side."""
        for words in self.names[other]:
            a, b = (typed, words) if len(typed) <= len(words) else (words, typed)
            cost, used = align(a, b, self.words.cost)
            left = [w for j, w in enumerate(b) if not used >> j & 1]
            if cost < 0.5 and (not left or (len(left) == 1 and left[0] in self.words.features and len(a) >= 3)):
                return True
        return False

    # -- resolving ----------------------------------------------------------------------------
    def candidates(self, tokens: Iterable[str]) -> set[str]:
        """Rows with a word of their own within one edit of one of the tokens, which may be of any length."""
        out: set[str] = set()
        for t in tokens:
            if t in self.words.common:
                continue
            out |= self.at.get(t, set())
            if len(t) >= 3:
                for word in {w for d in deletes(t) for w in self.near.get(d, ())}:
                    if self.words.cost(t, word) < 1:
                        out |= self.at[word]
        return out

    def abbreviated(self, tokens: Iterable[str]) -> set[str]:
        """Rows with a word of their own that one of the tokens may abbreviate."""
        out: set[str] = set()
        for t in tokens:
            if t not in self.words.common and len(t) >= 2:
                for word in self.short.get(t, set()) | (self.short.get(f"{t[0]}*{t[-1]}", set()) if not set(t[1:-1]) & set("aeiou") else set()):
                    if curt(t, word):
                        out |= self.at[word]
        return out

    def _fit(self, typed: Typed, sid: str) -> tuple[float, int] | None:
        """Cost and unsaid words of the best of the row's names, if it says all that is typed."""
        best = None
        for words in self.names[sid]:
            cost, used = align(typed.tokens, words, self.words.cost)
            own = [w for w in words if w not in self.words.common]
            said = any(used >> j & 1 and w in own for j, w in enumerate(words)) or not own
            # Initials alone mean nobody.
            if cost < 1.5 and said and any(len(t) > 1 for t in typed.tokens):
                score = (cost, len(words) - used.bit_count())
                best = min(best, score) if best else score
        return best

    def _only(self, sids: Iterable[str]) -> str | None:
        orgs = {self.find(s) for s in sids}
        return orgs.pop() if len(orgs) == 1 else None

    def resolve(self, name: str | None) -> str | None:
        """The organisation (its smallest row id) that a typed name means."""
        typed = Typed(name)
        if len(typed.calls) == 1 and not typed.tokens and typed.calls[0] not in self.calls:
            typed.tokens, typed.calls = typed.calls, []  # initials can look like a call sign
        if len(typed.tokens) > 2 and all(len(t) == 1 for t in typed.tokens):
            typed.tokens = ["".join(typed.tokens)]
        found = self._resolve(typed)
        # A letter that was lost to a separator has cut a word in two.
        at = 0
        while found is None and at + 1 < len(typed.tokens):
            a, b = typed.tokens[at : at + 2]
            if a not in self.words.common and b not in self.words.common and self.candidates([a + b]):
                joined = Typed(None)
                joined.tokens, joined.calls, joined.band, joined.the = [*typed.tokens[:at], a + b, *typed.tokens[at + 2 :]], typed.calls, typed.band, typed.the
                found = self._resolve(joined)
            at += 1
        return found

    def _resolve(self, typed: Typed) -> str | None:
        if not typed.tokens and not typed.calls:
            return None
        if typed.calls:
            sids = {s for c in typed.calls for s in self.calls.get(c, ())}
            if sids:
                if typed.band in ("fm", "am", "tv") and len({self.find(s) for s in sids}) > 1:
                    sids = {s for s in sids if _BANDS[typed.band] in {t for g in self.groups[self.find(s)] for v in self.names[g] for t in v}} or sids
                places = [t for t in typed.tokens if self._long(t) not in self.words.common and len(t) >= 4]
                if len({self.find(s) for s in sids}) > 1:
                    sids = {s for s in sids if any(self._fit(typed, g) for g in self.groups[self.find(s)])} or sids
                if places and not (self.candidates(places) | self.abbreviated(places)) & {g for s in sids for g in self.groups[self.find(s)]}:
                    return None
                return self._only(sids)
            if not typed.tokens:
                return None
        air = self._on_air(typed)
        if air:
            return air
        fits = self._fits(typed, self.candidates(typed.tokens))
        if not fits and len(typed.tokens) == 1 and typed.tokens[0] in self.initials:
            return self._only(self.initials[typed.tokens[0]])
        fits = fits or self._fits(typed, self.abbreviated(typed.tokens))
        if not fits and all(self._long(t) in self.words.common for t in typed.tokens):
            fits = self._fits(typed, self.plain)
        if fits:
            # An exact place outweighs a slip; equally good organisations leave the name open.
            least = min(c for c, _ in fits.values())
            near = {o: s for o, s in fits.items() if s[0] < least + 0.35}
            full = min(n for _, n in near.values())
            won = [o for o, (_, n) in near.items() if n == full]
            return won[0] if len(won) == 1 else None
        return None

    def _fits(self, typed: Typed, sids: Iterable[str]) -> dict[str, tuple[float, int]]:
        """Organisations that say all that is typed, each with its best cost and unsaid words."""
        fits: dict[str, tuple[float, int]] = {}
        for sid in sids:
            score = self._fit(typed, sid)
            if score:
                org = self.find(sid)
                fits[org] = min(fits.get(org, score), score)
        return fits

    def _on_air(self, typed: Typed) -> str | None:
        tokens = tuple(typed.tokens)
        sids = self.air.get(tokens)
        if sids:
            return self._only(sids)
        for n in (1, 2):
            sids = self.air.get(tokens[:-n]) if len(tokens) > n else None
            if sids:
                extra = [self._long(t) for t in tokens[-n:]]
                return self._only(s for s in sids if any(all(t in v for t in extra) for g in self.groups[self.find(s)] for v in self.names[g]))
        return None


def load_roster(roster: DataFrame) -> Roster:
    """The roster's index, of a roster whose size is checked."""
    rows = roster.where("station_id is not null").select("station_id", F.coalesce("station_name", F.lit("")), "notes", "page_url").limit(MAX_ROSTER + 1).collect()
    if len(rows) > MAX_ROSTER:
        raise ValueError(f"the roster has more than {MAX_ROSTER} rows")
    return Roster([tuple(r) for r in rows])


def resolve_names(spark: SparkSession, names: DataFrame, name_col: str, roster: DataFrame | Roster) -> DataFrame:
    """``name, station_id`` of each distinct spelling that means an organisation of the roster."""
    index = shared_object(spark, roster if isinstance(roster, Roster) else load_roster(roster))

    def resolve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = index()
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"name": pdf["name"], "station_id": [found.resolve(n) for n in pdf["name"]]})

    distinct = names.where(F.col(name_col).isNotNull()).select(F.col(name_col).alias("name")).distinct()
    return distinct.mapInPandas(resolve, "name string, station_id string").where("station_id is not null")


def roster_variants(spark: SparkSession, roster: DataFrame | Roster) -> DataFrame:
    """``record_key, station_id`` of the roster rows whose organisation has a smaller id."""
    found = roster if isinstance(roster, Roster) else load_roster(roster)
    rows = [(s, found.find(s)) for s in found.root if found.find(s) != s]
    return spark.createDataFrame(rows, "record_key string, station_id string")
