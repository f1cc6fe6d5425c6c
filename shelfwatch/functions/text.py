"""String columns with ECMAScript whitespace and null rules."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters ECMAScript counts as white space, for use inside
# a regex character class.  Java's own \s covers ASCII only.
SPACES = r"\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
# Any character but an ECMAScript line terminator.
ONE_LINE = r"[^\n\r\u2028\u2029]"


def trim_spaces(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{SPACES}]+|[{SPACES}]+$", "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def or_default(c: Column, default: Column) -> Column:
    """Absent and empty both give the default."""
    return F.coalesce(blank_to_null(c), default)


def entity_id(*keys: Column) -> Column:
    """Surrogate id from a natural key; 128 bits, so distinct keys stay apart at any size."""
    return F.md5(F.concat_ws("\u0001", *keys))


def timestamp(value) -> Column:
    """Columns pass through; Python values and text become timestamp literals."""
    return value if isinstance(value, Column) else F.lit(value).cast("timestamp")
