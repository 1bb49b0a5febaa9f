"""Path expressions: parsed once on the driver, compiled to chained reads."""

from __future__ import annotations

import re

from pyspark.sql import Column

from . import nodes

_NAME = re.compile(r"[^0-9\"\\][^\"\\]*")

Path = str | int | float | list | tuple


def parse(path: Path | None) -> list[str] | None:
    """Steps of a path; [''] is the root; None is no path."""
    if isinstance(path, bool) or path is None:
        return [""] if path is None else None
    if isinstance(path, str):
        return path.split(".")
    if isinstance(path, (int, float)):
        return [nodes._key(path)]
    if isinstance(path, (list, tuple)):
        return [nodes._key(p) if isinstance(p, (int, float)) else str(p) for p in path] or [""]
    return None


def resolve(path: Path | None, here: list[str] | None = None, names: dict[str, str] | None = None) -> list[str] | None:
    """Absolute steps. Empty steps are relative to ``here``: the first stays there, each further one goes up.

    names are values of $KEY-like steps; $$ is a plain $. None: nothing is there.
    """
    steps = parse(path)
    if steps is None or steps == [""]:
        return steps if steps is None else []
    here = list(here or [])
    out: list[str] = []
    k = 0
    while k < len(steps):
        step = steps[k]
        if step == "":
            dots = 0
            while k + 1 < len(steps) and steps[k + 1] == "":
                dots += 1
                k += 1
            if k == len(steps) - 1 and dots and k == dots:
                dots -= 1  # only dots: the last one ends the path
            if dots > len(here):
                return None
            out = here[: len(here) - dots]
        elif names and step in names:
            out.append(names[step])
        else:
            out.append(re.sub(r"\$\$", "$", step))
        k += 1
    return out


def getpath(v: Column, path: Path | None, alt: Column | None = None, here: list[str] | None = None) -> Column:
    """The value at path; absent and null give alt (SQL NULL)."""
    from pyspark.sql import functions as F

    from . import kinds

    steps = resolve(path, here)
    if steps is None:
        found = F.lit(None).cast("variant")
    else:
        found, k = v, 0
        while k < len(steps):
            run = next((j for j in range(k, len(steps)) if not _NAME.fullmatch(steps[j])), len(steps))
            if run > k:  # names that no list has: one read for the run of them
                found = F.variant_get(found, "$" + "".join(f'["{x}"]' for x in steps[k:run]), "variant")
            else:
                found, run = nodes.lookup(found, steps[k]), k + 1
            k = run
        found = kinds.present(found) if steps else found
    return found if alt is None else F.coalesce(found, alt)


def setpath(v: Column, path: Path, value: Column | None) -> Column:
    """The whole value with path set (value None: deleted). Missing or non-node steps become maps, lists in
    list paths where the next step is a number."""
    from pyspark.sql import functions as F

    from . import kinds

    steps = parse(path)
    kinds_of = list(path) if isinstance(path, (list, tuple)) else steps

    def put(node: Column, k: int) -> Column:
        fresh = "[]" if not isinstance(kinds_of[k], str) else "{}"

        def change(x: Column) -> Column:
            if k == len(steps) - 1:
                return nodes._without(x, steps[k]) if value is None else nodes._set(x, steps[k], value)
            return nodes.bind(put(nodes.lookup(x, steps[k]), k + 1), lambda new: nodes._set(x, steps[k], new))

        # each level is bound to a name, so that the expression grows by a fixed size with each step
        return nodes.bind(F.when(kinds.isnode(node), node).otherwise(F.parse_json(F.lit(fresh))), change)

    return put(nodes.writable(v), 0)


def setpath_parent(v: Column, path: Path, value: Column | None) -> Column:
    """The node that holds the value set by setpath."""
    return getpath(setpath(v, path, value), parse(path)[:-1])
