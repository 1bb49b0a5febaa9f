"""Text and list functions as built-in expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _range(length: Column, start: int | None, end: int | None) -> tuple[Column, Column]:
    """Start and length of what slice keeps. A negative start drops that many from the end (end is then ignored)."""
    if start is None and end is None:
        return F.lit(0), length
    start = 0 if start is None else start
    zero = F.lit(0)
    if start < 0:
        return zero, F.greatest(zero, length + start)
    stop = length if end is None else F.greatest(zero, length + end) if end < 0 else F.least(F.lit(end), length)
    return F.lit(start), F.greatest(zero, stop - start)


def slice_text(s: Column, start: int | None = None, end: int | None = None) -> Column:
    a, n = _range(F.length(s), start, end)
    return F.substring(s, a + 1, n)


def slice_list(a: Column, start: int | None = None, end: int | None = None) -> Column:
    at, n = _range(F.size(a), start, end)
    return F.slice(a, at + 1, n)


def slice_number(x: Column, start: float | None = None, end: float | None = None) -> Column:
    """Numbers are clamped to [start, end - 1]."""
    if start is not None:
        x = F.greatest(x, F.lit(start))
    return x if end is None else F.least(x, F.lit(end - 1))


def pad(s: Column, width: int = 44, char: str = " ") -> Column:
    """Pad to the right, for negative widths to the left; never cuts."""
    fill = (char or " ")[0]
    n = F.greatest(F.length(s), F.lit(abs(width)))
    return F.rpad(s, n, F.lit(fill)) if width >= 0 else F.lpad(s, n, F.lit(fill))


def join(parts: Column, sep: str = ",", url: bool = False) -> Column:
    """Join the non-empty strings of an array; with a one-character sep, doubled separators at seams collapse."""
    some = F.filter(parts, lambda x: x.isNotNull() & (x != ""))
    if len(sep) == 1:
        s = re.escape(sep)
        total = F.size(parts)

        def trim(x: Column, i: Column) -> Column:
            inner = F.regexp_replace(x, f"([^{s}]){s}+([^{s}])", f"$1{_dollar(sep)}$2")
            lead = F.when(i > 0, F.regexp_replace(inner, f"^{s}+", "")).otherwise(inner)
            last = (i == total - 1) if url else F.lit(False)
            kept = F.when(last, lead).otherwise(F.regexp_replace(lead, f"{s}+$", ""))
            # an address begins with a scheme, whose doubled separator stays
            return F.when(i == 0, F.regexp_replace(x, f"{s}+$", "")).otherwise(kept) if url else kept

        some = F.filter(F.transform(some, trim), lambda x: x != "")
    return F.array_join(some, sep)


def _dollar(text: str) -> str:
    return re.sub(r"([\\$])", r"\\\1", text)


def escre(s: Column) -> Column:
    """Escape the characters that mean something in regular expressions."""
    return F.regexp_replace(s, r"[.*+?^${}()|\[\]\\]", r"\\$0")


def escurl(s: Column) -> Column:
    """Percent-encode all but letters, digits and - _ . ! ~ * ' ( )."""
    out = F.url_encode(F.coalesce(s, F.lit("")))
    for a, b in ((r"\+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.regexp_replace(out, a, b)
    return out


def pathify(parts: Column, start: int = 0, end: int = 0) -> Column:
    """Dotted text of an array of string keys; the empty path is <root>."""
    kept = F.filter(parts, lambda x: x.isNotNull() & (x != ""))
    kept = F.slice(kept, start + 1, F.greatest(F.lit(0), F.size(kept) - start - end))
    return F.when(parts.isNull(), F.lit("<unknown-path>")).when(F.size(kept) == 0, F.lit("<root>")).otherwise(F.array_join(F.transform(kept, lambda x: F.replace(x, F.lit("."), F.lit(""))), "."))


def pathify_mixed(v: Column, start: int = 0, end: int = 0) -> Column:
    """Dotted text of a VARIANT list of keys (or of one key): texts without their dots, numbers floored, other parts left out.

    The range is taken from the parts as they stand; nothing left of it is <root>, and a value that is no path names itself.
    """
    from . import kinds, nodes

    start, end = max(0, start), max(0, end)

    def dotted(x: Column) -> Column:
        parts = F.coalesce(kinds.as_list(x), F.when(kinds.is_string(x) | kinds.is_number(x), F.array(x)))
        ranged = F.slice(parts, start + 1, F.greatest(F.lit(0), F.size(parts) - start - end))
        keys = F.transform(F.filter(ranged, kinds.iskey), lambda k: F.replace(kinds.strkey(k), F.lit("."), F.lit("")))
        unknown = F.concat(F.lit("<unknown-path:"), kinds.stringify(x, 47), F.lit(">"))
        return F.when(x.isNull(), F.lit("<unknown-path>")).when(parts.isNull(), unknown).when(F.size(ranged) == 0, F.lit("<root>")).otherwise(F.array_join(keys, "."))

    return nodes.bind(v, dotted)


def flatten(a: Column, depth: int = 1) -> Column:
    for _ in range(depth):
        a = F.flatten(a)
    return a


def flatten_mixed(v: Column, depth: int = 1) -> Column:
    """array<variant> of a VARIANT list whose lists, and theirs to the depth, are replaced by their elements."""
    from . import kinds

    out = kinds.as_list(v)
    for _ in range(depth):
        out = F.flatten(F.transform(out, lambda x: F.coalesce(kinds.as_list(x), F.array(x))))
    return out


# ---------------------------------------------------------------- regular expressions (a portable subset)

#: Constructs outside the subset: look-around, back-references, atomic groups and possessive repeats.
FORBIDDEN = (r"\(\?[=!>]", r"\(\?<[=!]", r"\\[1-9]", r"\\k<", r"[*+?}]\+")


def re_compile(pattern: str) -> str:
    """The pattern, if it belongs to the subset; else ValueError."""
    plain = re.sub(r"\\\\", "", pattern)
    for bad in FORBIDDEN:
        if re.search(bad, plain):
            raise ValueError(f"unsupported regular expression: {pattern}")
    try:
        re.compile(re.sub(r"\(\?<(\w)", r"(?P<\1", pattern))
    except re.error as e:
        raise ValueError(f"invalid regular expression: {pattern}: {e}") from e
    return pattern


def _groups(pattern: str) -> int:
    return re.compile(re.sub(r"\(\?<(\w)", r"(?P<\1", pattern)).groups


def re_test(pattern: str, s: Column) -> Column:
    return F.regexp_like(s, F.lit(re_compile(pattern)))


def re_find(pattern: str, s: Column) -> Column:
    """array(whole, group 1, ...) of the first match, or NULL."""
    p = re_compile(pattern)
    return F.when(re_test(p, s), F.array(*(F.regexp_extract(s, p, g) for g in range(_groups(p) + 1))))


def re_find_all(pattern: str, s: Column) -> Column:
    """Array of such arrays for all matches."""
    p = re_compile(pattern)
    each = [F.regexp_extract_all(s, F.lit(p), F.lit(g)) for g in range(_groups(p) + 1)]
    return F.transform(each[0], lambda x, i: F.array(x, *(F.get(e, i) for e in each[1:])))


def re_replace(pattern: str, s: Column, to) -> Column:
    """Replace all matches; $1 to $9 are groups, $& is the whole. to can be a function of the array [whole, group 1, ...]."""
    if not callable(to):
        return F.regexp_replace(s, re_compile(pattern), re.sub(r"\$&", r"$0", to))
    if re.search(re.sub(r"\(\?<(\w)", r"(?P<\1", re_compile(pattern)), ""):
        raise ValueError("a function needs a pattern that does not match the empty text")
    between = F.split(s, pattern, -1)
    made = F.transform(re_find_all(pattern, s), to)
    return F.array_join(F.transform(between, lambda x, i: F.concat(x, F.coalesce(F.get(made, i), F.lit("")))), "")
