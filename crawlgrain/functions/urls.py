"""URL parsing and canonical form as Column expressions (no UDF; runs inside generated code)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PARTS = r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def _clean(url: Column) -> Column:
    """Outer white space goes, as do tabs and line ends inside."""
    return F.regexp_replace(F.trim(F.regexp_replace(url, r"^[\x00-\x20]+|[\x00-\x20]+$", "")), r"[\t\r\n]", "")


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(_clean(url), _PARTS, 1))


def _authority(url: Column) -> Column:
    """Without user information."""
    return F.regexp_replace(F.regexp_extract(_clean(url), _PARTS, 2), r"^.*@", "")


def host(url: Column) -> Column:
    """Lower-cased host name without port and brackets; '' where there is none."""
    a = _authority(url)
    return F.lower(F.when(F.startswith(a, F.lit("[")), F.regexp_extract(a, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_extract(a, r"^([^:]*)", 1)))


def port_text(url: Column) -> Column:
    return F.regexp_extract(_authority(url), r"^(?:\[[^\]]*\]|[^:\[]*):(.*)$", 1)


def port(url: Column) -> Column:
    """Port number, null where none is given or it isn't one."""
    text = port_text(url)
    return F.when(text.rlike(r"^[0-9]{1,9}$"), F.try_to_number(text, F.lit("999999999")).cast("int"))


def url_error(url: Column) -> Column:
    """Why a URL has no canonical form; null if it has one."""
    text, number = port_text(url), port(url)
    return (
        F.when(url.isNull() | (_clean(url) == ""), F.lit("empty url"))
        .when(scheme(url) == "", F.lit("missing scheme or host"))
        .when(host(url) == "", F.lit("missing scheme or host"))
        .when((text != "") & (number.isNull() | (number > 65535)), F.lit("invalid port"))
    )


def _netloc(url: Column) -> Column:
    number, s, h = port(url), scheme(url), host(url)
    default = number.isNull() | ((s == "http") & (number == 80)) | ((s == "https") & (number == 443))
    return F.when(default, h).otherwise(F.concat_ws(":", h, number.cast("string")))


def _path(url: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(_clean(url), _PARTS, 3), r"/+$", "")


def _form_decode(text: Column) -> Column:
    """Each valid escape decoded; a % that begins none stands for itself."""
    return F.try_url_decode(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"))


def _form_encode(text: Column) -> Column:
    """Form encoding that leaves ~ and encodes *."""
    return F.replace(F.replace(F.url_encode(text), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def _query(url: Column) -> Column:
    """Pairs decoded, sorted by key and value in code-point order, encoded again; blanks are kept."""
    raw = F.filter(F.split(F.regexp_extract(_clean(url), _PARTS, 4), "&"), lambda x: x != "")
    pair = F.transform(
        raw,
        lambda x: F.struct(_form_decode(F.substring_index(x, "=", 1)).alias("k"), _form_decode(F.when(F.contains(x, F.lit("=")), F.regexp_extract(x, r"(?s)^[^=]*=(.*)$", 1)).otherwise("")).alias("v")),
    )
    return F.array_join(F.transform(F.array_sort(pair), lambda p: F.concat(_form_encode(p["k"]), F.lit("="), _form_encode(p["v"]))), "&")


def canonical_url(url: Column) -> Column:
    """Lower-cased scheme and host, no default port, fragment, user information or trailing slashes, sorted query; null if invalid."""
    query = _query(url)
    made = F.concat(scheme(url), F.lit("://"), _netloc(url), _path(url), F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)))
    return F.when(url_error(url).isNull(), made)


def url_hash(canonical: Column) -> Column:
    return F.sha2(canonical, 256)


def request_host(url: Column) -> Column:
    """The authority with port and user information, or the path of a URL without one, lower-cased."""
    net = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    return F.lower(F.when(net != "", net).otherwise(F.regexp_extract(url, r"^([^?#]*)", 1)))


def link_host(href: Column, base_host: Column, base_scheme: Column) -> Column:
    """Host of a link resolved against a page; null where the result has no host (mailto: and the like)."""
    h = F.trim(href)
    return (
        F.when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), F.nullif(host(h), F.lit("")))
        .when(F.startswith(h, F.lit("//")), F.nullif(host(F.concat(base_scheme, F.lit(":"), h)), F.lit("")))
        .when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), F.lit(None).cast("string"))
        .otherwise(base_host)
    )
