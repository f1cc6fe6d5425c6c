"""Host and path of a URL as columns.

`parse_url` raises on bad input and `try_parse_url` gives NULL for hosts with
`_`, so both parts come from regexes.  The rare cases (percent-encoding, back
slashes, dot segments) sit behind one test, so ordinary URLs pay for two
regexes only.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hosts import ENDS_IN_NUMBER, ascii_host, bound, ipv4, ipv6
from .text import SPACES, blank_to_null

_SCHEME = rf"(?i)^[{SPACES}]*https?:[/\\]*"
_NAME = r"[^/\\:?#@\[\]\s<>^|%]"
_HOST = rf"(\[[0-9a-f:.]+\]|(?:{_NAME}|%[0-9a-f]{{2}})+)"
# A port has at most 16 bits.
_PORT = r"0*(?:[0-9]{0,4}|[1-5][0-9]{4}|6[0-4][0-9]{3}|65[0-4][0-9]{2}|655[0-2][0-9]|6553[0-5])"
_AUTHORITY = _SCHEME + r"(?:[^/\\?#]*@)?" + _HOST + rf"(?::{_PORT})?(?=[/\\?#]|[{SPACES}]*$)"
# Hosts that stay as they are: ASCII, and the last label begins with a letter and is no hexadecimal number.
_PLAIN_HOST = r"^(?:[!-$&-Z\\^-~]*\.)?[a-z_][!-$&-,/-Z\\^-~-]*$"
_BYTE = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_PATH = _SCHEME + rf"[^/\\?#]+([^?#]*?)(?:[{SPACES}]*$|[?#])"
# Characters a URL path carries percent-encoded.
_ENCODED = r"""[^!-~]|["<>`{}^]"""
_DOTS = r"/(?:\.|%2[eE]){1,2}(?:/|$)"
_RARE = _ENCODED + r"|\\|" + _DOTS
# Most URLs: a lower-case scheme and host and a path that stays as it is; host and path are cut at slashes and before a query.
_PLAIN_URL = r"(?s)^https?://[a-z][a-z0-9.-]*+(?:/(?![.%])[!$-.0-;=@-\[\]_a-z|~]*+)++(?:[?#].*)?\z"


def url_host(url: Column) -> Column:
    """Lower-case host without user info and port; NULL when the URL is invalid.

    Percent-encoded hosts are decoded, international labels are given in ASCII, and hosts that end in a
    number or stand in brackets are addresses in their standard form.
    """
    return bound(F.lower(F.regexp_extract(url, _AUTHORITY, 1)), _standard_host)


def _standard_host(host: Column) -> Column:
    return F.when(host.rlike(_PLAIN_HOST), host).when(host != "", _special_host(host))


def _special_host(host: Column) -> Column:
    named = bound(bound(_decoded(host), ascii_host), _named_host)
    return F.when(host.startswith("["), ipv6(host)).otherwise(named)


def _decoded(host: Column) -> Column:
    decoded = F.lower(F.try_url_decode(F.replace(host, F.lit("+"), F.lit("%2B"))))
    return F.when(F.contains(host, F.lit("%")), F.when(decoded.rlike(rf"^{_NAME}+$"), decoded)).otherwise(host)


def written_host(url: Column) -> Column:
    """As `url_host`, but international and numeric hosts stay as they are written, four decimal numbers being bytes.

    It stays inside generated code; the site rules need no more.
    """
    host = _decoded(F.lower(F.regexp_extract(url, _AUTHORITY, 1)))
    numbers = host.rlike(r"^[0-9]+(?:\.[0-9]+){3}$")
    return blank_to_null(F.when(~numbers | host.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"), host))


def _named_host(host: Column) -> Column:
    return F.when(host.rlike(ENDS_IN_NUMBER), ipv4(host)).otherwise(host)


def _encode_char(c: Column) -> Column:
    return F.when(c == " ", F.lit("%20")).when(c.rlike(_ENCODED), F.url_encode(c)).otherwise(c)


def _percent_encode(path: Column) -> Column:
    chars = F.regexp_extract_all(path, F.lit("(?s)(.)"), F.lit(1))
    return F.array_join(F.transform(chars, _encode_char), "")


def _is_dots(seg: Column, n: int) -> Column:
    return seg.rlike(r"^(?:\.|%2[eE]){" + str(n) + "}$")


def _resolve_dots(path: Column) -> Column:
    segments = F.split(F.substring(path, 2, 2147483647), "/", -1)
    kept = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(_is_dots(s, 2), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(_is_dots(s, 1), acc)
        .otherwise(F.array_append(acc, s)),
    )
    last = F.element_at(segments, -1)
    tail = F.when(_is_dots(last, 1) | _is_dots(last, 2), F.array_append(kept, F.lit(""))).otherwise(kept)
    return F.concat(F.lit("/"), F.array_join(tail, "/"))


def _raw_path(url: Column) -> Column:
    return F.regexp_extract(url, _PATH, 1)


def _clean_path(raw: Column) -> Column:
    coded = _percent_encode(F.translate(raw, "\\", "/"))
    fixed = F.when(coded.rlike(_DOTS), _resolve_dots(coded)).otherwise(coded)
    return F.when(raw == "", F.lit("/")).when(raw.rlike(_RARE), fixed).otherwise(raw)


def url_path(url: Column) -> Column:
    """Path without query and fragment; `/` when empty, NULL when the URL is invalid."""
    return F.when(url_host(url).isNotNull(), _clean_path(_raw_path(url)))


def with_url_parts(df: DataFrame, host: str = "host", path: str = "path") -> DataFrame:
    """Adds `written_host` and path of column `url`, each regex run once per row; plain URLs pass one test only."""
    url, plain = F.col("url"), F.col("_plain")
    tested = df.select("*", url.rlike(_PLAIN_URL).alias("_plain"))
    cut = F.substring_index(F.substring_index(url, "/", 3), "/", -1)
    # Behind the two slashes of the scheme and a host of at least one character.
    rest = F.substr(url, F.locate("/", url, 9))
    rest = F.substring_index(F.substring_index(rest, "?", 1), "#", 1)
    raw = tested.select(
        "*",
        F.when(plain, cut).otherwise(written_host(url)).alias(host),
        F.when(plain, rest).otherwise(_raw_path(url)).alias("_raw"),
    )
    clean = F.when(plain, F.col("_raw")).when(F.col(host).isNotNull(), _clean_path(F.col("_raw")))
    return raw.select(*df.columns, host, clean.alias(path))
