"""URL expressions: normalising, allow list, ids in canonical and redirect URLs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: paths of a post page.
POST_PATH = r"^/(?:discovery/item|explore|items)/([0-9a-fA-F]{24})(?:/|$)"
#: Fixed value: 24 hexadecimal digits.
HEX24 = r"\b([0-9a-fA-F]{24})\b"


def normalize_url(c: Column) -> Column:
    """Trimmed; host-like text without a scheme gets http://."""
    s = F.trim(c)
    return F.when(~s.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://") & s.rlike(r"^[\w-]+(\.[\w-]+)+([/?#:]|$)"), F.concat(F.lit("http://"), s)).otherwise(s)


def url_host(c: Column) -> Column:
    """Host in lower case without trailing dots; empty for bad URLs."""
    return F.coalesce(F.rtrim(F.lower(F.try_parse_url(c, F.lit("HOST"))), F.lit(".")), F.lit(""))


def allowed_url(c: Column, roots: Sequence[str]) -> Column:
    """http or https on the usual ports (fixed values: none, 80, 443), at one of the root hosts or below."""
    host = url_host(c)
    port = F.regexp_extract(F.coalesce(F.try_parse_url(c, F.lit("AUTHORITY")), F.lit("")), r":(\d*)$", 1)
    at_root = F.lit(False)
    for root in roots:
        at_root = at_root | (host == root) | F.endswith(host, F.lit("." + root))
    return F.coalesce(F.lower(F.try_parse_url(c, F.lit("PROTOCOL"))).isin("http", "https") & port.isin("", "80", "443") & at_root, F.lit(False))


def post_id_from_url(c: Column, roots: Sequence[str]) -> Column:
    """The post id of a canonical URL, or null."""
    found = F.regexp_extract(F.coalesce(F.try_parse_url(c, F.lit("PATH")), F.lit("")), POST_PATH, 1)
    return F.when(allowed_url(c, roots) & (found != ""), F.lower(found))


def embedded_post_id(c: Column) -> Column:
    """The first id in a redirect's url parameter, else (no or an empty parameter) anywhere; empty if none."""
    inner = F.try_url_decode(F.coalesce(F.nullif(F.try_parse_url(c, F.lit("QUERY"), F.lit("url")), F.lit("")), c))
    return F.coalesce(F.lower(F.regexp_extract(F.coalesce(inner, c), HEX24, 1)), F.lit(""))
