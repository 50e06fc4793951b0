"""Canonical keys of accounts and page addresses, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What stands in a field in place of a missing name or address.
STAND_INS = ("", "-", "--", "?", ".", "n/a", "na", "none", "null", "nan", "nil", "unknown", "anonymous", "anon", "[deleted]", "[removed]", "deleted", "removed", "[unknown]", "[anonymous]", "(unknown)", "(none)", "undefined", "not available", "unbekannt", "anonym")
#: Query parameters that only say how a reader came to a page.
TRACKING = r"(?:utm_[A-Za-z]+|fbclid|gclid|msclkid|mc_cid|mc_eid)"
_BLANK = r"[\s  -‍ ⁠　﻿]+"


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{_BLANK}|{_BLANK}$", "")


def account_key(author: Column) -> Column:
    """An account's name without letter case, outer blanks and the marks ``@``, ``u/``, ``/u/``; null for stand-ins."""
    name = F.lower(_trim(author))
    name = F.when(name.isin(*STAND_INS), F.lit(None)).otherwise(_trim(F.regexp_replace(name, r"^(?:@|/?u(?:ser)?/|~)+", "")))
    return F.when(name.isin(*STAND_INS), F.lit(None)).otherwise(name)


def page_key(address: Column) -> Column:
    """A page's address without scheme, ``www.``, default port, fragment, tracking parameters and closing slash, host in lower case, parameters in order; null for stand-ins."""
    a = _trim(address)
    a = F.when(F.lower(a).isin(*STAND_INS), F.lit(None)).otherwise(a)
    a = F.regexp_replace(F.regexp_replace(a, r"^(?i:[a-z][a-z0-9+.]*:)?//", ""), r"#.*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(a, r"^[^/?]*", 0)), r"^www\.|:(?:80|443)$", "")
    host = F.regexp_replace(host, r":(?:80|443)$|\.$", "")
    path = F.regexp_replace(F.regexp_extract(a, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(a, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(rf"^{TRACKING}(?:=|$)")))
    key = F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))
    return F.when(key == "", F.lit(None)).otherwise(key)
