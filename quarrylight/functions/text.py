"""Column functions on strings: normalisation, escaping, base64, entropy. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII word boundary; the regex engine's own boundary also counts accented letters as words.
BOUNDARY = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


#: White space as scripts know it, for a character class; the regex engine's own class is ASCII.
SPACES = "\t-\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def with_spaces(p: str) -> str:
    r"""A pattern whose \s and \S mean SPACES, inside character classes (\s only) and outside."""
    out, inside, i = [], False, 0
    while i < len(p):
        two = p[i : i + 2]
        if two == r"\s":
            out.append(SPACES if inside else f"[{SPACES}]")
        elif two == r"\S" and not inside:
            out.append(f"[^{SPACES}]")
        elif p[i] == "\\":
            out.append(two)
        else:
            inside = p[i] == "[" or inside and p[i] != "]"
            out.append(p[i])
            i -= 1
        i += 2
    return "".join(out)


def spark_pattern(p: str) -> str:
    """A rule's pattern in Spark's dialect: <b> is an ASCII word boundary, <z> the end of the text."""
    return with_spaces(p.replace("<b>", BOUNDARY).replace("<z>", r"\z"))


def clean_value(v: Column) -> Column:
    """Without one quote at either end, then without white space around."""
    return F.regexp_replace(F.regexp_replace(v, r"""^["']|["']\z""", ""), rf"^[{SPACES}]+|[{SPACES}]+\z", "")


def html_escape(v: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        v = F.replace(v, F.lit(raw), F.lit(safe))
    return v


def decode_base64(v: Column) -> Column:
    """Binary of a base64 text, or null if it is none."""
    shaped = (F.length(v) % 4 == 0) & v.rlike(r"^[A-Za-z0-9+/]*={0,2}\z")
    return F.when(shaped, F.try_to_binary(v, F.lit("base64")))


def is_base64(v: Column) -> Column:
    """True if decoding and encoding gives the same text again."""
    again = F.regexp_replace(F.base64(decode_base64(v)), r"[\r\n]", "")
    return F.coalesce(again == v, F.lit(False))


def entropy(v: Column) -> Column:
    """Shannon entropy in bits per character."""
    chars = F.split(v, "")
    n = F.length(v).cast("double")
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))


def host_of(url: Column) -> Column:
    """Lower-case host name of an absolute URL, '' if there is none."""
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://(?:[^/?#@]*@)?([^/:?#]+)", 1))


def directory_of(url: Column) -> Column:
    """Up to and including the last slash."""
    return F.regexp_extract(url, r"^(.*/)?", 0)


def remote_name(url: Column) -> Column:
    """File name of a fetched URL: the last segment without its query."""
    return F.coalesce(F.nullif(F.regexp_extract(url, r"([^/?]*)(?:\?.*)?$", 1), F.lit("")), F.lit("remote_file.js"))


def relative_age(then: Column, now: Column) -> Column:
    """'just now', '5m ago', '3h ago', '2d ago', or the date."""
    m = (F.unix_millis(now) - F.unix_millis(then)) / 60_000
    ago = lambda x, unit: F.concat(F.floor(x).cast("string"), F.lit(f"{unit} ago"))
    return F.when(m < 1, "just now").when(m < 60, ago(m, "m")).when(m < 1440, ago(m / 60, "h")).when(m < 43_200, ago(m / 1440, "d")).otherwise(F.date_format(then, "yyyy-MM-dd"))
