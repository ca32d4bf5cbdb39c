"""Content checks: type, captcha marks, links, headers, compression."""

from __future__ import annotations

import gzip
import json
from collections.abc import Iterator
from html.entities import html5

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the domain.
HTML_TYPES = ["text/html", "application/xhtml+xml"]
CAPTCHA_MARKERS = "captcha|recaptcha|hcaptcha|verify you are human"
CAPTCHA_BYTES = 131072
KEPT_HEADERS = ["content-type", "content-length", "last-modified", "etag", "cache-control", "server"]


def is_html(content_type: Column) -> Column:
    return F.coalesce(F.lower(F.trim(F.substring_index(content_type, ";", 1))).isin(HTML_TYPES), F.lit(False))


def contains_captcha(content_type: Column, body: Column) -> Column:
    """Only where the type names text or html, or is empty; only the first CAPTCHA_BYTES bytes count."""
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    start = F.substring(body.cast("binary"), 1, CAPTCHA_BYTES).cast("string")
    return ((kind == "") | kind.rlike("text|html")) & F.coalesce(F.lower(start).rlike(CAPTCHA_MARKERS), F.lit(False))


def failure_reason(status: Column) -> Column:
    return F.when(status.isin(403, 429, 503), F.concat(F.lit("HTTP_"), status.cast("string")))


_WS = r"[ \t\n\f\r]"
#: Attributes and white space of a tag up to its >: a value is quoted, or ends at white space or >.
_VALUE = r"""(?:"[^"]*+(?:"|\z)|'[^']*+(?:'|\z)|[^ \t\n\f\r>"'][^ \t\n\f\r>]*+)"""
_NAME = r"[^ \t\n\f\r/>][^ \t\n\f\r/>=]*+"
_ATTRIBUTE = rf"{_NAME}(?:{_WS}*+={_WS}*+{_VALUE}?+)?+"
_REST = rf"(?:(?:{_WS}|/)++|{_ATTRIBUTE})*+"
_RAW = "script|style|textarea|title|xmp|iframe|noembed|noframes"  # elements whose content holds no tags
#: What a tokenizer sees of a page, one alternative for each state: comments, raw text, <a> (group 2: its attributes), other tags, declarations, a tag that never ends.
_TOKEN = (
    rf"(?is)<!--(?:-?>|.*?(?:--!?>|\z))|<({_RAW})(?=[ \t\n\f\r/>]){_REST}>.*?(?:</\1(?=[ \t\n\f\r/>]){_REST}>?|\z)"
    rf"|<a(?=[ \t\n\f\r/>])({_REST})>|</?[a-z][^ \t\n\f\r/>]*+{_REST}>|<[!?/](?![a-z])[^>]*+>?|</?[a-z].*+"
)
_HREF = rf"(?is)^(?:(?:{_WS}|/)++|(?!href(?:[ \t\n\f\r/=]|\z)){_ATTRIBUTE})*+href(?:{_WS}*+={_WS}*+({_VALUE}))?"
#: Names that count without a semicolon too, unless a letter, digit or = follows.
_LEGACY = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
_REFERENCE = rf"&(?:#[xX][0-9a-fA-F]++;?+|#[0-9]++;?+|[A-Za-z][A-Za-z0-9]*+;|(?:{'|'.join(_LEGACY)})(?![=A-Za-z0-9]))"


def _code_point(number: Column) -> Column:
    """The character of a numeric reference: what Windows means by 128 to 159, U+FFFD for what is no character."""
    old = F.from_json(F.lit(json.dumps({str(n): bytes([n]).decode("cp1252", "replace") for n in range(128, 160)})), "map<string,string>")
    fine = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
    text = F.decode(F.unhex(F.concat(F.lit("00000020"), F.lpad(F.hex(number), 8, "0"))), "UTF-32")  # a space before, since a decoder may drop the first U+FEFF
    return F.when(number.between(128, 159), F.try_element_at(old, number.cast("string"))).when(fine, F.substring(text, 2, 1)).otherwise(F.lit("\ufffd"))


def unescape(text: Column) -> Column:
    """text with its character references replaced, as in an attribute's value; unknown names stay."""

    def one(ref: Column) -> Column:
        digits = F.regexp_extract(ref, "([0-9a-fA-F]+);?$", 1)
        number = F.when(F.lower(F.substring(ref, 3, 1)) == "x", F.conv(digits, 16, 10)).otherwise(F.conv(digits, 10, 10))
        number = F.when(F.length(digits) <= 9, number.cast("long")).otherwise(F.lit(0).cast("long"))
        named = F.coalesce(F.try_element_at(names, F.substring(ref, 2, 99)), ref)
        return F.when(F.startswith(ref, F.lit("&#")), _code_point(number)).otherwise(named)

    names = F.from_json(F.lit(json.dumps(html5)), "map<string,string>")
    refs = F.transform(F.regexp_extract_all(text, F.lit(_REFERENCE), F.lit(0)), one)
    joined = F.zip_with(F.split(text, _REFERENCE, -1), refs, lambda p, r: F.concat(p, F.coalesce(r, F.lit(""))))
    return F.when(F.contains(text, F.lit("&")), F.array_join(joined, "")).otherwise(text)


def hrefs(html: Column) -> Column:
    """Targets of <a href> in document order, as a browser reads them.

    Values may be quoted or not, character references are resolved, the first href of a tag counts, one without a value is ''.
    Comments, scripts, styles and other raw text hold no links; nor does a tag that never ends.
    """
    tags = F.filter(F.regexp_extract_all(html, F.lit(_TOKEN), F.lit(2)), lambda t: t.rlike(_HREF))
    return F.transform(tags, lambda t: unescape(F.regexp_replace(F.regexp_extract(t, _HREF, 1), r"""(?s)^(["'])(.*)\1$""", "$2")))


def kept_headers(headers: Column) -> Column:
    """Names lower-cased, allow-listed ones only, the last of equal names."""
    lower = F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    names = F.filter(F.array(*map(F.lit, KEPT_HEADERS)), lambda n: F.exists(lower, lambda e: e["key"] == n))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(F.filter(lower, lambda e: e["key"] == n), -1)["value"]))


@F.pandas_udf(T.BinaryType())
def gzip_bytes(bodies: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """gzip with mtime 0, so equal bodies give equal bytes. Spark has no built-in for it."""
    for s in bodies:
        yield s.map(lambda b: None if b is None else gzip.compress(bytes(b), mtime=0))


@F.pandas_udf(T.BinaryType())
def gunzip_bytes(bodies: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in bodies:
        yield s.map(lambda b: None if b is None else gzip.decompress(bytes(b)))
