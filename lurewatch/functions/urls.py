"""Column functions on URLs. One authority pattern is used instead of parse_url, which gives null for
hosts in other alphabets and keeps the case."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lurewatch import reference_lists as lists
from lurewatch.functions.domains import text

SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*://"
# Not behind a word character, "@" or ".", so "user@www.x.test" is no link.
TEXT_URL = r"(?U)(?i)(?<![\w@.])((?:https?://|www\.)[^\s<>\"')\]]+)"
TRAILING = ".,;:!?"
SHOWN_SCHEME_URL = r"(?U)https?://\S+"
SHOWN_BARE_HOST = r"(?U)(?<![\w@.-])((?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+[a-z]{2,24})(?![\w-])"


def authority(url: Column) -> Column:
    return F.regexp_extract(text(url), SCHEME + r"([^/?#]*)", 1)


def userinfo(url: Column) -> Column:
    return F.regexp_extract(authority(url), r"^(.*)@[^@]*$", 1)


def host(url: Column) -> Column:
    """Host in lower case without user info, port and trailing dot; empty when unreadable."""
    place = F.substring_index(authority(url), "@", -1)
    named = F.substring_index(place, ":", 1)
    return F.rtrim(F.lower(F.when(place.startswith("["), F.regexp_extract(place, r"^\[([^\]]*)\]", 1)).otherwise(named)), F.lit("."))


def path(url: Column) -> Column:
    return F.regexp_extract(text(url), SCHEME + r"[^/?#]*([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(text(url), r"^[^?#]*\?([^#]*)", 1)


def normalized(url: Column) -> Column:
    """Scheme and authority in lower case, no slash at the end."""
    url = F.trim(url)
    head = F.regexp_extract(url, SCHEME + "[^/?#]*", 0)
    return F.rtrim(F.concat(F.lower(head), F.substring(url, F.length(head) + 1, F.length(url))), F.lit("/"))


def web_url(candidate: Column) -> Column:
    """The candidate as a web link; null for mailto:, tel:, anchors and relative paths."""
    url = F.trim(F.regexp_replace(candidate, r"[\t\r\n]", ""))
    low = F.lower(url)
    return F.when(low.startswith("http://") | low.startswith("https://"), url).when(
        low.startswith("www."), F.concat(F.lit("http://"), url)
    )


def urls_in_text(body: Column) -> Column:
    found = F.transform(F.regexp_extract_all(body, F.lit(TEXT_URL), 1), lambda u: web_url(F.rtrim(u, F.lit(TRAILING))))
    return F.filter(found, lambda u: u.isNotNull())


def shown_hosts(anchor: Column) -> Column:
    """Hosts that a link text shows: full addresses first, then bare host names."""
    anchor = F.lower(text(anchor))
    full = F.transform(
        F.regexp_extract_all(anchor, F.lit(SHOWN_SCHEME_URL), 0), lambda u: host(F.rtrim(u, F.lit(".,;:!?)")))
    )
    bare = F.regexp_extract_all(F.regexp_replace(anchor, SHOWN_SCHEME_URL, " "), F.lit(SHOWN_BARE_HOST), 1)
    known = F.filter(
        bare, lambda h: F.substring_index(h, ".", -1).isin(lists.SHOWN_TLDS) | h.startswith("www.")
    )
    return F.concat(F.filter(full, lambda h: h != ""), known)


def demo_target(url: Column, site: str) -> Column:
    """The stand-in page for a reserved demo domain; null for any other host."""
    name, where, asked = host(url), path(url), query(url)
    reserved = F.lit(False)
    for ending in lists.DEMO_TLDS:
        reserved = reserved | name.endswith(ending)
    return F.when(
        reserved,
        F.concat(
            F.lit(site + "/"), name, F.when(where == "", "/").otherwise(where),
            F.when(asked == "", "").otherwise(F.concat(F.lit("?"), asked)),
        ),
    )
