"""Address expressions: normal forms, hosts, paths and redirects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions.text import col

#: Parameters that only track a click.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "mc_cid", "mc_eid")


def host(c: Column | str) -> Column:
    """Lower case, without port and ``www.``."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.trim(col(c)), r"^[A-Za-z]+://([^/?#:]*)", 1)), r"^www\.", "")


def path(c: Column | str) -> Column:
    """The path without slashes at its end; ``/`` where there is none."""
    p = F.regexp_extract(F.trim(col(c)), r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.nullif(F.regexp_replace(p, "/+$", ""), F.lit("")), F.lit("/"))


def normalized(c: Column | str, drop: Sequence[str] = TRACKING) -> Column:
    """Scheme and host in lower case, tracking dropped, parameters sorted, no fragment and no slash at the end."""
    u = F.trim(col(c))
    root = F.lower(F.regexp_extract(u, r"^([A-Za-z]+://[^/?#]*)", 1))
    p = F.regexp_replace(F.regexp_extract(u, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1), "/+$", "")
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~F.lower(F.split_part(x, F.lit("="), F.lit(1))).isin(*drop)))
    return F.concat(root, p, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def page_key(c: Column | str) -> Column:
    """A page whatever its scheme, ``www.``, query or fragment."""
    return F.concat(host(c), F.when(path(c) == "/", "").otherwise(path(c)))


def is_web_address(c: Column | str) -> Column:
    return F.coalesce(F.trim(col(c)).rlike(r"(?i)^https?://[^/?#\s]+"), F.lit(False))


def secure(c: Column | str, hosts: Sequence[str]) -> Column:
    """``http`` becomes ``https`` on the given hosts; blanks are escaped."""
    u = F.replace(F.trim(col(c)), F.lit(" "), F.lit("%20"))
    return F.when(host(u).isin(*hosts), F.regexp_replace(u, "(?i)^http://", "https://")).otherwise(u)


def parameter(c: Column | str, name: str) -> Column:
    return F.nullif(F.regexp_extract(col(c), rf"[?&]{name}=([^&#]*)", 1), F.lit(""))


def unwrapped(c: Column | str, names: Sequence[str] = ("url", "u", "q", "target")) -> Column:
    """The address inside a search redirect - plain, escaped, or in base 64 after ``a1`` - else the address itself."""
    web = lambda v: F.when(v.rlike("^https?://"), v)
    inner = []
    for n in names:
        raw = F.try_url_decode(parameter(c, n))
        coded = F.rpad(F.translate(F.substring(raw, 3, 1 << 20), "-_", "+/"), (F.ceil((F.length(raw) - 2) / 4) * 4).cast("int"), "=")
        inner += [web(raw), F.when(raw.rlike("^a1[A-Za-z0-9+/_-]+=*$"), web(F.try_to_binary(coded, F.lit("base64")).cast("string")))]
    return F.coalesce(*inner, col(c))


def root(c: Column | str) -> Column:
    return F.nullif(F.lower(F.regexp_extract(F.trim(col(c)), r"^([A-Za-z]+://[^/?#]+)", 1)), F.lit(""))


def joined(base: Column | str, link: Column | str) -> Column:
    """A link seen on a page as a full address (absolute, rooted or beside the page)."""
    b, h = col(base), F.trim(col(link))
    folder = F.regexp_extract(F.regexp_replace(b, "[?#].*$", ""), r"^([A-Za-z]+://[^/]+(?:/.*)?)/[^/]*$", 1)
    return F.when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), h).when(h.startswith("//"), F.concat(F.regexp_extract(b, "^([A-Za-z]+:)", 1), h)).when(h.startswith("/"), F.concat(root(b), h)).otherwise(F.concat(F.coalesce(F.nullif(folder, F.lit("")), root(b)), F.lit("/"), h))
