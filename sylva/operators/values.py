"""The whole function set over plain Python values, for use inside Arrow functions, hooks and on the driver.

Columns have the same functions as built-in expressions in ``sylva.functions``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from typing import Any
from urllib.parse import quote

from ..functions import kinds
from ..functions.scalars import re_compile
from .shapes import matches, select, validate
from .trees import ABSENT, DELETE, FORMATS, MAXDEPTH, SKIP, View, clone, condense, delprop, expand, getelem, getpath, getprop, inject, is_key, is_node, iscondensed, items, jsonify, keysof, lookup, merge, pathify, plain, setpath, setprop, strkey, stringify, transform, typename, typify, walk

# Phases of a template node.
M_KEYPRE, M_KEYPOST, M_VAL = 1, 2, 4
MODENAME = {M_VAL: "val", M_KEYPRE: "key:pre", M_KEYPOST: "key:post"}

isnode, iskey, condenseview = is_node, is_key, View


def ismap(v: Any) -> bool:
    return isinstance(v, dict)


def islist(v: Any) -> bool:
    return isinstance(v, list)


def isfunc(v: Any) -> bool:
    return callable(v)


def isempty(v: Any) -> bool:
    return v is ABSENT or v is None or isinstance(v, (str, list, dict)) and not v


def size(v: Any) -> int:
    if isinstance(v, (str, list, dict)):
        return len(v)
    if isinstance(v, (bool, int)):
        return int(v)
    return math.floor(v) if isinstance(v, float) and math.isfinite(v) else 0


def getdef(v: Any, alt: Any) -> Any:
    return alt if v is ABSENT else v


def haskey(v: Any, key: Any) -> bool:
    return getprop(v, key) is not ABSENT


def filter(v: Any, check: Callable[[tuple[str, Any]], bool]) -> list:
    """Values (not pairs) of the entries that pass."""
    return [x for k, x in items(v) if check((k, x))] if is_node(v) else []


def flatten(v: Any, depth: int = 1) -> Any:
    if not isinstance(v, list) or depth < 1:
        return v
    return [y for x in v for y in (flatten(x, depth - 1) if isinstance(x, list) else [x])]


def slice(v: Any, start: int | None = None, end: int | None = None) -> Any:
    """A negative start drops that many from the end, a negative end counts from it; numbers are clamped to [start, end - 1]."""
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        low = v if start is None else max(v, start)
        return low if end is None else min(low, end - 1)
    if not isinstance(v, (str, list)) or start is None and end is None:
        return v
    start, n = start or 0, len(v)
    if start < 0:
        return v[: max(0, n + start)]
    stop = n if end is None else max(0, n + end) if end < 0 else end
    return v[start:stop]


def pad(v: Any, width: int = 44, char: str = " ") -> str:
    text, fill = stringify(v), (char or " ")[0]
    return text.ljust(width, fill) if width >= 0 else text.rjust(-width, fill)


def join(parts: Any, sep: str = ",", url: bool = False) -> str:
    """Non-empty strings joined; a one-character separator does not double at the seams."""
    if not isinstance(parts, list):
        return ""
    some = [p for p in parts if isinstance(p, str) and p]
    if len(sep) != 1:
        return sep.join(some)
    out, run = [], re.compile(rf"(?<=[^{re.escape(sep)}]){re.escape(sep)}+(?=[^{re.escape(sep)}])")
    for i, p in enumerate(some):
        if url and i == 0:
            out.append(p.rstrip(sep))
            continue
        p = run.sub(lambda _: sep, p)
        p = p.lstrip(sep) if i else p
        out.append(p if url and i == len(parts) - 1 else p.rstrip(sep))
    return sep.join(p for p in out if p)


def escre(s: Any) -> str:
    return re.sub(r"[.*+?^${}()|\[\]\\]", r"\\\g<0>", s) if isinstance(s, str) else ""


def escurl(s: Any) -> str:
    return quote(s, safe="-_.!~*'()") if isinstance(s, str) else ""


def jm(*pairs: Any) -> dict:
    """A map of keys and values in turn; a key that is no string is written as text, a last value left out is null."""
    keys, values = pairs[::2], [*pairs[1::2], None][: (len(pairs) + 1) // 2]
    return {k if isinstance(k, str) else stringify(k): None if v is ABSENT else v for k, v in zip(keys, values, strict=True)}


def jt(*values: Any) -> list:
    return [None if v is ABSENT else v for v in values]


def re_test(pattern: str, s: str) -> bool:
    return re.search(_py(pattern), s) is not None


def re_find(pattern: str, s: str) -> list | None:
    m = re.search(_py(pattern), s)
    return [m[0], *m.groups()] if m else None


def re_find_all(pattern: str, s: str) -> list[list]:
    return [[m[0], *m.groups()] for m in re.finditer(_py(pattern), s)]


def re_replace(pattern: str, s: str, to: str | Callable[[list], str]) -> str:
    """All matches replaced; $1 to $9 are groups, $& the whole; or a function of [whole, groups...]."""
    def put(m: re.Match) -> str:
        if callable(to):
            return to([m[0], *m.groups()])
        return re.sub(r"\$(&|[1-9])", lambda d: m[0] if d[1] == "&" else (m[int(d[1])] or "") if int(d[1]) <= m.re.groups else "", to)

    return re.sub(_py(pattern), put, s)


re_escape = escre


def _py(pattern: str) -> str:
    """The checked pattern, named groups as Python writes them."""
    return re.sub(r"\(\?<(\w)", r"(?P<\1", re_compile(pattern))
