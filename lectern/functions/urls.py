"""URL expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lectern.functions.text import decode_entities

SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*):"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def host_of(url: str | Column) -> Column:
    """Host in lower case, without user, port and closing dot; null for text that is no absolute URL."""
    place = F.regexp_extract(_col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^/?#:@]*)", 1)
    return F.nullif(F.rtrim(F.lower(place), F.lit(".")), F.lit(""))


def canonical_url(url: str | Column) -> Column:
    """Without query, fragment and one closing `/` or `.html`."""
    bare = F.regexp_replace(_col(url), r"(?s)[?#].*$", "")
    return F.regexp_replace(bare, r"(?:/|\.html)$", "")


def absolute_url(base: str | Column, ref: str | Column) -> Column:
    """`ref` as found on page `base`, made absolute.

    Null for what leads to no other document: empty and fragment-only
    references and schemes other than http(s). Dot segments stay as written.
    """
    base = _col(base)
    scheme = F.regexp_extract(base, SCHEME, 1)
    site = F.regexp_extract(base, r"^([^:/?#]+://[^/?#]*)", 1)
    path = F.regexp_extract(base, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)
    folder = F.regexp_extract(path, r"^(.*/)", 1)

    def resolved(ref: Column) -> Column:
        return (
            F.when((ref == "") | ref.startswith("#"), F.lit(None).cast("string"))
            .when(F.lower(ref).rlike("^https?://"), ref)
            .when(ref.rlike(SCHEME), F.lit(None).cast("string"))
            .when(ref.startswith("//"), F.concat(scheme, F.lit(":"), ref))
            .when(ref.startswith("/"), F.concat(site, ref))
            .when(ref.startswith("?"), F.concat(site, path, ref))
            .otherwise(F.concat(site, F.when(folder == "", "/").otherwise(folder), ref))
        )

    # Bound to a variable, so that it is decoded once and not in every branch.
    decoded = F.trim(decode_entities(_col(ref), bare=False))
    return F.get(F.transform(F.array(decoded), resolved), F.lit(0))
