"""URL canonicalization as one expression."""

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import strip

VERSION = 1
#: Query parameters that only track.
TRACKING = ["ref", "ref_src", "ref_url", "fbclid", "gclid", "gclsrc", "dclid", "msclkid", "igshid", "mkt_tok", "_hsenc", "_hsmi", "vero_id", "yclid"]
TRACKING_PREFIXES = ["utm_", "mc_"]
#: Scheme, slashes with authority, authority, path, query and fragment.
URL_PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(//([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


@F.pandas_udf(T.StringType())
def idna_host(h: pd.Series) -> pd.Series:
    """Punycode of hosts that are not ASCII; what cannot be encoded stays."""

    def encode(host):
        try:
            return host.encode("idna").decode("ascii")
        except UnicodeError:
            return host

    return h.map(encode, na_action="ignore")


def arxiv_id(path: Column) -> Column:
    """The version-free paper id in a path, new style before old style, or null."""
    path = F.regexp_replace(path, r"(?i)\.pdf$", "")
    new = F.regexp_extract(path, r"(?U)(\d{4}\.\d{4,5})", 1)
    old = F.regexp_extract(path, r"(?iU)([a-z-]+(?:\.[A-Za-z]{2})?/\d{7})", 1)
    return F.coalesce(F.nullif(new, F.lit("")), F.nullif(old, F.lit("")))


def is_tracking(name: Column, extra=()) -> Column:
    name = F.lower(name)
    found = name.isin([*TRACKING, *[e.lower() for e in extra]])
    for p in TRACKING_PREFIXES:
        found = found | F.startswith(name, F.lit(p))
    return found


def _form_decode(c: Column) -> Column:
    """Form decoding in which a stray ``%`` stands for itself."""
    return F.try_url_decode(F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25"))


def _form_encode(c: Column) -> Column:
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonical_query(query: Column, extra=()) -> Column:
    """Parameters in order, decoded and encoded anew, without tracking ones."""
    parts = F.filter(F.split(query, "&"), lambda p: p != "")
    pairs = F.transform(parts, lambda p: F.struct(
        _form_decode(F.substring_index(p, "=", 1)).alias("k"),
        F.when(F.contains(p, F.lit("=")), _form_decode(F.substring(p, F.instr(p, "=") + 1, F.length(p)))).otherwise("").alias("v")))
    kept = F.filter(pairs, lambda p: ~is_tracking(p["k"], extra))
    return F.array_join(F.transform(kept, lambda p: F.concat(_form_encode(p["k"]), F.lit("="), _form_encode(p["v"]))), "&")


def canonical_url(url, extra=(), idn: bool = True) -> Column:
    """The canonical form of a URL; null for null, a bad port or a bad host.

    Scheme and host are lowered, the host is punycode, userinfo and default
    ports go, an empty path is ``/`` and others lose trailing slashes, tracking
    parameters go and the rest is encoded anew, the fragment stays. Paper URLs of
    arxiv.org become their abstract's. With ``idn=False`` no Python runs; hosts
    outside ASCII then stay as they are.
    """
    u = F.regexp_replace(strip(url), r"[\t\r\n]", "")
    part = lambda i: F.regexp_extract(u, URL_PARTS, i)
    scheme, authority, path, query, fragment = F.lower(part(1)), part(3), part(4), part(5), part(6)
    netloc = F.regexp_replace(authority, "^.*@", "")
    bracketed = F.startswith(netloc, F.lit("["))
    host = F.lower(F.when(bracketed, F.regexp_extract(netloc, r"^\[([^\]]*)\]", 1)).otherwise(F.substring_index(netloc, ":", 1)))
    if idn:
        ascii_ = host.rlike(r"^\p{ASCII}*$")
        host = F.coalesce(F.when(ascii_, host), idna_host(F.when(~ascii_, host)))
    port = F.regexp_extract(netloc, r"^(?:\[[^\]]*\]|[^:\[]*):(.*)$", 1)
    number = F.when(port.rlike("^[0-9]{1,9}$"), port.cast("int"))
    bad = (port != "") & (number.isNull() | (number > 65535))
    default = ((scheme == "http") & (number == 80)) | ((scheme == "https") & (number == 443))
    shown = F.concat(host, F.when(number.isNotNull() & ~default, F.concat(F.lit(":"), number.cast("string"))).otherwise(""))
    trimmed = F.when(path == "", "/").when(path == "/", "/").otherwise(F.regexp_replace(path, "/+$", ""))
    q = canonical_query(query, extra)
    full = F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""),
        F.when((part(2) != "") | scheme.isin("http", "https"), F.concat(F.lit("//"), shown)).otherwise(""),
        F.when((shown != "") & (trimmed != "") & ~F.startswith(trimmed, F.lit("/")), F.concat(F.lit("/"), trimmed)).otherwise(trimmed),
        F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""),
        F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(""),
    )
    paper = F.when((host == "arxiv.org") | F.endswith(host, F.lit(".arxiv.org")), arxiv_id(path))
    return F.when(bad, F.lit(None).cast("string")).otherwise(F.coalesce(F.concat(F.lit("https://arxiv.org/abs/"), paper), full))


def canonical_hash(url, extra=(), idn: bool = True) -> Column:
    return F.sha2(canonical_url(url, extra, idn), 256)
