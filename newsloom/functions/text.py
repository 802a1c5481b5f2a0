"""Text expressions, all native columns: folding, slugs, mark-up, cutting, snippets, names and term tests.

Nulls stay null unless a function says otherwise. Patterns use explicit character classes where
engines differ about ``\\w`` and ``\\b``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from functools import reduce
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def collapse(c: Column | str) -> Column:
    """Runs of white space become one blank, none at the ends."""
    return F.trim(F.regexp_replace(col(c), r"[\s\u00A0]+", " "))


def query_text(c: Column | str, collapse_spaces: bool = False) -> Column:
    """Lower case, every character outside a-z, 0-9 and backslash a blank; blanks stay apart unless collapsed."""
    out = F.regexp_replace(F.lower(col(c)), r"[^a-z0-9\\]", " ")
    return collapse(out) if collapse_spaces else F.trim(out)


def slug(c: Column | str, empty: str = "unknown") -> Column:
    out = F.regexp_replace(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(out, F.lit("")), F.lit(empty))


def unescape(c: Column | str) -> Column:
    """Named and numbered entities as characters, once; unknown ones and those without a semicolon stay."""
    names = {k[:-1]: v for k, v in html5.items() if k.endswith(";")}
    table = F.from_json(F.lit(json.dumps(names, ensure_ascii=False)), "map<string,string>")
    found = lambda s: F.regexp_extract(s, r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});", 1)

    def number(m: Column) -> Column:
        n = F.when(m.rlike("^#[xX]"), F.conv(F.substring(m, 3, 8), 16, 10).try_cast("int")).when(m.startswith("#"), F.substring(m, 2, 8).try_cast("int"))
        return F.when(n.between(1, 0xD7FF) | n.between(0xE000, 0x10FFFF), F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")).when(n.isNotNull(), F.lit("\ufffd"))

    def piece(s: Column) -> Column:
        m = found(s)
        said = F.coalesce(number(m), F.try_element_at(table, m))
        return F.when((m != "") & said.isNotNull(), F.concat(said, F.substring(s, F.length(m) + 2, F.length(s)))).otherwise(F.concat(F.lit("&"), s))

    parts = F.split(col(c), "&", -1)
    return F.when(col(c).contains("&"), F.array_join(F.transform(parts, lambda s, i: F.when(i == 0, s).otherwise(piece(s))), "")).otherwise(col(c))


def without_tags(c: Column | str) -> Column:
    return F.regexp_replace(col(c), "<[^>]*>", " ")


def plain_text(c: Column | str) -> Column:
    """Entities first, then tags: escaped tags go too."""
    return collapse(without_tags(unescape(c)))


def stripped_html(c: Column | str) -> Column:
    """Tags first, then entities: escaped tags stay as text."""
    return collapse(unescape(without_tags(c)))


def shortened(c: Column | str, limit: int = 220, mark: str = "…") -> Column:
    """At most ``limit`` characters, cut back to a blank."""
    t = col(c)
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.regexp_replace(F.substring(t, 1, limit - 1), " [^ ]*$", ""), F.lit(mark)))


def curly_quotes(c: Column | str) -> Column:
    """Double quotes open and close by turns; apostrophes become typographic."""
    parts = F.split(F.replace(col(c), F.lit("'"), F.lit("’")), '"')
    marked = F.transform(parts, lambda x, i: F.when(i == 0, x).when(i % 2 == 1, F.concat(F.lit("“"), x)).otherwise(F.concat(F.lit("”"), x)))
    return F.array_join(marked, "")


def headline_core(c: Column | str, rewrites: Sequence[tuple[str, str]] = ()) -> Column:
    """The headline without its last `` - source`` part, in lower case, with some phrases in their short form."""
    core = F.lower(F.trim(F.regexp_replace(col(c), r"^(.*) - .*$", "$1")))
    return reduce(lambda a, r: F.replace(a, F.lit(r[0]), F.lit(r[1])), rewrites, core)


def tokens(c: Column | str, pattern: str = "[a-z0-9]+") -> Column:
    return F.regexp_extract_all(F.lower(col(c)), F.lit(f"({pattern})"), 1)


def fingerprint(c: Column | str, stopwords: Sequence[str], most: int = 12, rewrites: Sequence[tuple[str, str]] = ()) -> Column:
    """The first words of a headline's core that aren't stop words."""
    kept = F.filter(tokens(headline_core(c, rewrites)), lambda w: ~w.isin(*stopwords))
    return F.array_join(F.slice(kept, 1, most), " ")


def bounded(term: str) -> str:
    """Pattern of a term that stands by itself in lower-case text; for tests, not for counting."""
    return f"(^|[^a-z0-9]){re.escape(term.lower())}($|[^a-z0-9])"


def has_term(c: Column | str, term: str) -> Column:
    return F.lower(col(c)).rlike(bounded(term))


def has_any_term(c: Column | str, terms: Sequence[str]) -> Column:
    """One alternation for all terms, so a text is read once."""
    return F.lower(col(c)).rlike("(^|[^a-z0-9])(" + "|".join(re.escape(t.lower()) for t in terms) + ")($|[^a-z0-9])") if terms else F.lit(False)


def term_hits(c: Column | str, terms: Sequence[str]) -> Column:
    """The terms of a list that a text holds as substrings, in the list's order."""
    low = F.lower(col(c))
    return F.filter(F.array(*[F.when(low.contains(t.lower()), F.lit(t)) for t in terms]), lambda x: x.isNotNull()) if terms else F.array().cast("array<string>")


def call_signs(c: Column | str, never: Sequence[str] = ()) -> Column:
    """Call signs written in capitals, with their suffix, in order and once each; ``never``: words that only look like one."""
    found = F.array_distinct(F.regexp_extract_all(col(c), F.lit(r"\b([KW][A-Z]{2,4}(?:-(?:FM|TV|DT|AM|LP|LD|CD))?)\b"), 1))
    return F.filter(found, lambda x: ~x.isin(*never)) if never else found


def call_sign_forms(c: Column | str) -> Column:
    """A call sign with and without its band."""
    return F.array_distinct(F.array(F.upper(F.trim(col(c))), F.regexp_replace(F.upper(F.trim(col(c))), "-?(FM|TV|AM)$", "")))


def digits(c: Column | str) -> Column:
    return F.nullif(F.regexp_replace(col(c), "[^0-9]", ""), F.lit(""))


def name_tokens(c: Column | str, generic: Sequence[str] = ()) -> Column:
    """Words of a name without the generic ones; ``&`` reads as and."""
    words = F.split(F.trim(F.regexp_replace(F.replace(F.lower(col(c)), F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", " ")), " +")
    return F.filter(words, lambda w: (w != "") & ~w.isin(*generic) if generic else w != "")


def org_key(c: Column | str, generic: Sequence[str] = ("the", "inc", "llc", "corp", "of", "and", "foundation", "friends")) -> Column:
    return F.array_join(name_tokens(c, generic), " ")


def alias_forms(c: Column | str) -> Column:
    """Spellings under which a name is looked up: as it is, without an ending, without ``the``, as initials."""
    low = collapse(F.lower(col(c)))
    bare = F.trim(F.regexp_replace(low, r",? (inc|llc|corp)\.?$", ""))
    initials = F.array_join(F.transform(F.split(F.regexp_replace(bare, "[^a-z0-9 ]", ""), " +"), lambda w: F.substring(w, 1, 1)), "")
    return F.array_distinct(F.filter(F.array(low, bare, F.regexp_replace(bare, "^the ", ""), F.replace(bare, F.lit(" "), F.lit("-")), initials), lambda x: F.length(x) > 1))


def title_from_filename(c: Column | str) -> Column:
    base = F.element_at(F.split(col(c), "/"), -1)
    return collapse(F.regexp_replace(F.regexp_replace(base, r"\.[A-Za-z0-9]{1,5}$", ""), "[-_]+", " "))


def safe_filename(c: Column | str, most: int = 120) -> Column:
    """A name that any file system takes: letters, digits, dots and dashes."""
    clean = F.regexp_replace(F.regexp_replace(F.trim(col(c)), r"[^A-Za-z0-9._-]+", "-"), r"^[-.]+|[-.]+$", "")
    return F.coalesce(F.nullif(F.substring(clean, 1, most), F.lit("")), F.lit("document"))


def document_title(title: Column | str, url: Column | str) -> Column:
    """The title; without one the last part of the address's path, else the address."""
    base = F.element_at(F.split(F.regexp_replace(F.regexp_replace(col(url), "[?#].*$", ""), "^[A-Za-z]+://[^/]*", ""), "/"), -1)
    return F.coalesce(F.nullif(collapse(title), F.lit("")), F.nullif(base, F.lit("")), col(url))


def name_from_stem(c: Column | str) -> Column:
    """A station's name out of a file's stem: without leading numbers, report marks and years."""
    marks = "(AFR|AFRS|FSR|FSRS|AFS)"
    cut = [r"^\d+[-_ ]*", rf"(?i)[_-]{marks}([_-]?\d{{4}})?$", rf"(?i)\b{marks}\b([_ -]?\d{{4}})?$", r"[_-]+\d{4}$"]
    bare = reduce(lambda a, p: F.regexp_replace(a, p, ""), cut, col(c))
    return F.coalesce(F.nullif(F.regexp_replace(collapse(F.replace(bare, F.lit("_"), F.lit(" "))), "^[ _-]+|[ _-]+$", ""), F.lit("")), col(c))


def without_band(c: Column | str) -> Column:
    bare = F.regexp_replace(collapse(F.regexp_replace(col(c), r"(?i)\b(FM|AM|TV)$", "")), "^[ _-]+|[ _-]+$", "")
    return F.coalesce(F.nullif(bare, F.lit("")), col(c))


def publisher_hint(c: Column | str, known: dict[str, str]) -> Column:
    """The domain that a headline's tail names: of a known publisher, or written out."""
    tail = F.lower(F.trim(F.regexp_extract(col(c), r"^.* - (.*)$", 1)))
    named = F.coalesce(*[F.when(tail == n, F.lit(domain)) for n, domain in known.items()]) if known else F.lit(None).cast("string")
    return F.coalesce(named, F.when(tail.rlike(r"^[a-z0-9.-]+\.[a-z]{2,}$"), tail))


def is_named_person(c: Column | str) -> Column:
    """At least two capitalised words."""
    return F.regexp_count(col(c), F.lit(r"\b[A-Z][a-z]+(?:[-'][A-Z][a-z]+)?\b")) >= 2


def low_quality(c: Column | str, head: int = 300) -> Column:
    """Too few letters at the start, or too many characters outside ASCII."""
    t = F.substring(col(c), 1, head)
    odd = F.length(F.regexp_replace(t, r"[\x00-\x7F]", ""))
    return (F.length(F.regexp_replace(t, r"[^\p{L}]", "")) < 40) | (odd > F.greatest(F.lit(10), F.floor(F.length(t) / 10)))


def around(c: Column | str, pattern: str, before: int, after: int) -> Column:
    """The text around the first match of a pattern; null without one."""
    t = col(c)
    at = F.regexp_instr(t, F.lit(pattern))
    start = F.greatest(at - before, F.lit(1))
    return F.when(at > 0, collapse(F.substring(t, start, at - start + after)))


def first_sentence(c: Column | str, least: int = 25, most: int = 260) -> Column:
    return F.nullif(F.regexp_extract(collapse(c), rf"^(.{{{least - 1},{most - 1}}}?[.!?])(?: |$)", 1), F.lit(""))


def highlight(c: Column | str, patterns: Sequence[str], most: int = 260) -> Column:
    """The sentence of the first pattern that matches, else the first sentence, else the beginning."""
    t = collapse(c)
    hits = [F.nullif(F.regexp_extract(t, rf"(?i)({p}[^.]{{0,220}}\.)", 1), F.lit("")) for p in patterns]
    out = F.coalesce(*hits, first_sentence(c), F.substring(t, 1, most))
    return F.when(F.length(out) > most, F.concat(F.substring(out, 1, most - 3), F.lit("..."))).otherwise(out)


def clamp_words(c: Column | str, most: int, trailing: Sequence[str] = ("a", "an", "the", "of", "and", "to", "in", "for")) -> Column:
    """The first words, without a function word at the end."""
    words = F.array_join(F.slice(F.split(collapse(c), " "), 1, most), " ")
    return F.regexp_replace(words, "(?i)( (" + "|".join(trailing) + "))+$", "")
