"""transform: by-example templates compiled to columns.

A leaf that is one backtick reference keeps the type of what it names, references inside text become text, other leaves
are literals. Maps become nested rows, lists become arrays (of VARIANT if mixed). Commands: `$COPY`, `$DELETE`, `$KEY`, `$BT`,
`$DS`, `$WHEN`; as list heads `$EACH`, `$REF`, `$FORMAT`, `$APPLY`; as map keys `$PACK` and `$MERGE`.
References with leading dots go up from the data beside them. Absent values are NULL (the fields of a column type are fixed); specs whose
shape depends on the data go through sylva.operators.trees instead. Misplaced commands raise when the template is compiled.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, MapType, StringType, StructType, VariantType

from ..functions import kinds, nodes, paths
from ..plans.node import ABSENT, Node
from .merge import merge_variants
from .trees import has_ref, misplaced
from .walk import MAXDEPTH, by_levels

_FULL = re.compile(r"`(\$[A-Z]+\d*|[^`]*)`")
_PART = re.compile(r"`([^`]*)`")
DROP = object()
#: Column types of a spec's literals.
_TYPES = {str: "string", int: "bigint", float: "double", bool: "boolean"}


@dataclass
class Context:
    """Where a template is being compiled: the root, the data beside it and its path, and what names mean."""

    root: Node
    here: Node
    spec: object
    key: Column | None = None
    step: str | None = None
    extra: dict[str, Callable] = field(default_factory=dict)
    going: tuple[str, ...] = ()
    above: tuple[Node, ...] = ()  # from the root to what holds ``here``
    meta: dict = field(default_factory=dict)
    field: str | None = None  # names the key instead (a sibling `$KEY`)
    modify: Callable | None = None  # (leaf, its key, context) -> Node or Column, after a leaf is made
    handler: Callable | None = None  # (value, reference, context) -> Node or Column, after a reference is resolved

    def down(self, at: str, **more) -> Context:
        """Beside the value at a step of what is beside this."""
        return replace(self, here=self.here.get(at), above=(*self.above, self.here), **more)

    def slot(self) -> Context:
        """Beside the value that this place has itself."""
        return self if self.step is None else self.down(self.step, step=None)


_SPECIAL = re.compile(r"\$(GET|REF|META):(.*)\$")


def _constant(store, path: str) -> str:
    """Text of a constant at a path of a spec or of meta."""
    for step in paths.resolve(path) or []:
        store = store.get(step) if isinstance(store, dict) else store[int(step)] if isinstance(store, list) and step.isdigit() and int(step) < len(store) else None
    return "" if store is None or isinstance(store, (dict, list)) else str(store)


def _reference(ref: str, cx: Context) -> Node:
    found = _found(ref, cx)[-1]
    return _value(cx.handler(found, ref, cx)) if cx.handler else found


def _modified(made, spec, key: str, cx: Context):
    """A leaf after the modify hook; maps, lists and what is left out stay."""
    if not cx.modify or made is DROP or isinstance(spec, (dict, list, tuple)):
        return made
    return _value(cx.modify(made if isinstance(made, Node) else _literal_node(spec, made), key, cx))


def _found(ref: str, cx: Context) -> tuple[Node, ...]:
    """The value at a path, after those that hold it from the root on."""
    ref = ref.replace("$BT", "`").replace("$DS", "$") if len(ref) > 3 else ref
    steps = paths.parse(ref) if ref else []
    keys: dict[str, Column] = {}  # steps that are columns
    for k, step in enumerate(steps):
        m = _SPECIAL.fullmatch(step)
        if m and m[1] == "GET":
            keys[step] = F.coalesce(cx.root.path(paths.resolve(m[2])).text(), F.lit(""))
        elif m:
            steps[k] = _constant(cx.spec if m[1] == "REF" else cx.meta, m[2])
            if not steps[k]:
                return (ABSENT,)
        elif step == "$KEY" and cx.key is not None:
            keys[step] = cx.key
    trail = [*cx.above, cx.here] if cx.above else [cx.here]
    marks = [f"\0{k}" for k in range(1, len(trail))]
    at = paths.resolve(steps, marks) if steps else []
    if at is None:
        return (ABSENT,)
    up = sum(step in marks for step in at)
    nodes_ = list(trail[: up + 1]) if ref.startswith(".") else [cx.root]
    at = at[up:]
    if at and at[0] == "$TOP" and (cx.root.is_variant or cx.root.get("$TOP").absent):
        at = at[1:]
    for step in at:
        nodes_.append(nodes_[-1].at(keys[step]) if step in keys else nodes_[-1].get(step))
    return tuple(nodes_)


def _leaf(text: str, cx: Context):
    m = _FULL.fullmatch(text)
    if not m:
        pieces, at = [], 0
        for m in _PART.finditer(text):
            if m.start() > at:
                pieces.append(F.lit(text[at : m.start()]))
            pieces.append(F.coalesce(_value(_command(m[1], cx)).text() if m[1].startswith("$") else _reference(m[1], cx).text(), F.lit("")))
            at = m.end()
        if not pieces:
            return F.lit(text)
        if at < len(text):
            pieces.append(F.lit(text[at:]))
        return F.concat(*pieces)
    ref = m[1]
    if re.fullmatch(r"\$[A-Z]+\d*", ref):
        return _command(ref, cx)
    return _reference(ref, cx)


def _value(x) -> Node:
    return x if isinstance(x, Node) else ABSENT if x is DROP else _typed(x)


def _typed(c: Column) -> Node:

    return Node(c, StringType())


def _command(name: str, cx: Context):
    base = re.sub(r"\d+$", "", name)
    if base in cx.extra:
        return cx.extra[base](cx)
    if base == "$COPY":
        return cx.here.child(cx.step) if cx.step is not None else cx.here  # of VARIANT a stored null stays
    if base == "$DELETE":
        return DROP
    if base == "$TOP":
        return cx.root
    if base == "$SPEC":
        return nodes.as_variant(F.lit(None)) if cx.spec is None else F.parse_json(F.lit(json.dumps(cx.spec)))
    if base == "$KEY":
        if cx.field is not None:
            return cx.here.path(paths.resolve(cx.field))
        return F.lit(None).cast("string") if cx.key is None else cx.key
    if base == "$BT":
        return F.lit("`")
    if base == "$DS":
        return F.lit("$")
    if base == "$WHEN":
        return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return DROP  # unknown names are absent


# ---------------------------------------------------------------- formats


def _integer(n: Column) -> Column:
    """Truncated to 32 bits."""
    whole = F.when(n.isNull() | F.isnan(n), F.lit(0)).otherwise(n.cast("long"))
    low = whole.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    return F.when(low >= (1 << 31), low - (1 << 32)).otherwise(low)


def _number(node: Node) -> Column:
    if node.is_variant:
        return F.coalesce(node.number(), kinds.boolean(node.col).cast("double"), node.string().try_cast("double"), F.lit(0.0))
    if isinstance(node.kind, StringType):
        return F.coalesce(node.col.try_cast("double"), F.lit(0.0))
    return F.coalesce(node.column.cast("double"), F.lit(0.0))


FORMATS: dict[str, Callable[[Node], Column]] = {
    "identity": lambda n: n.column,
    "upper": lambda n: F.upper(F.coalesce(n.text(), F.lit("null"))),
    "lower": lambda n: F.lower(F.coalesce(n.text(), F.lit("null"))),
    "string": lambda n: F.coalesce(n.text(), F.lit("null")),
    "number": _number,
    "integer": lambda n: _integer(_number(n)),
    "concat": lambda n: F.array_join(F.transform(n.column, lambda x: Node(x, n.kind.elementType).text()), "") if isinstance(n.kind, ArrayType) else F.coalesce(n.text(), F.lit("")),
}


def _format(name, child, cx: Context):
    how = FORMATS.get(name) if isinstance(name, str) else name
    if how is None:
        raise ValueError(f"$FORMAT: unknown format: {name}.")
    own = cx.slot()
    if isinstance(child, list) and not _is_command(child):
        places = [replace(own, step=str(i)) for i in range(len(child))]
        if name == "concat":
            return F.concat(F.lit(""), *(_leaf_text(x, at) for x, at in zip(child, places, strict=True)))
        made = [_format(name, x, at) for x, at in zip(child, places, strict=True)]
        return F.array(*made) if made else F.array()
    if isinstance(child, dict) and child and not _is_command(child) and not any(k.startswith("`$") for k in child):
        return F.struct(*(_format(name, x, replace(own, step=k)).alias(k) for k, x in child.items()))
    got = compile_spec(child, cx)
    node = got if isinstance(got, Node) else _literal_node(child, got)
    if isinstance(node.kind, ArrayType) and name != "concat":
        return F.transform(node.column, lambda x: how(Node(x, node.kind.elementType)))
    if isinstance(node.kind, StructType):
        return F.struct(*(how(node.get(f.name)).alias(f.name) for f in node.kind.fields))
    return how(node)


def _leaf_text(spec, cx: Context) -> Column:
    """What concat takes of an element: maps and lists are empty."""
    got = compile_spec(spec, cx)
    if got is DROP or isinstance(spec, dict) or isinstance(spec, list) and not _is_command(spec):
        return F.lit("")
    if isinstance(got, Node):
        return F.lit("") if isinstance(got.kind, (ArrayType, MapType, StructType)) else F.when(kinds.isnode(got.as_variant()), F.lit("")).otherwise(F.coalesce(got.text(), F.lit("null"))) if got.is_variant else F.coalesce(got.text(), F.lit("null"))
    return F.coalesce(got.cast("string"), F.lit("null"))


def _literal_node(spec, col: Column) -> Node:

    kind = BooleanType() if isinstance(spec, bool) else LongType() if isinstance(spec, int) else DoubleType() if isinstance(spec, float) else StringType()
    return Node(col, kind)


# ---------------------------------------------------------------- structure


def _collection(path: str, cx: Context) -> tuple[Node, ...]:
    """The collection that a command names, after what holds it."""
    path = path.strip("`")
    if path == "":
        return (cx.root,)
    if path == ".":
        own = cx.slot()
        return (*own.above, own.here)
    return _found(path, cx)


def _inside(found: tuple[Node, ...], element: Node, key: Column, cx: Context) -> Context:
    """Beside an element of a collection."""
    return replace(cx, here=element, above=found, key=key, step=None, field=None)


def _children(source: Node) -> tuple[Column, Callable[[Column], Node], Callable[[Column, Column], Column]] | None:
    """The elements as an array, each one's node and key."""
    t = source.kind
    if isinstance(t, ArrayType):
        return source.column, (lambda x: Node(x, t.elementType)), lambda x, i: i.cast("string")
    if isinstance(t, MapType):
        return nodes.entries(source.column), (lambda x: Node(x["value"], t.valueType)), lambda x, i: x["key"]
    if isinstance(t, VariantType):
        return nodes.items(source.column), (lambda x: Node.variant(x["value"])), lambda x, i: x["key"]
    return None


def _each(path: str, child, cx: Context) -> Column:
    source = _collection(path, cx)
    kids = _children(source[-1])
    if kids is None:
        return F.array()
    array, node, key = kids
    made = F.transform(array, lambda x, i: _column(compile_spec(child, _inside(source, node(x), key(x, i), cx))))
    return F.coalesce(made, F.expr("array()"))


def _pack(args, cx: Context) -> Column:
    path, child = args
    source = _collection(path, cx)
    kids = _children(source[-1])
    if kids is None:
        return F.lit(None)
    array, node, key = kids
    name = child.get("`$KEY`") if isinstance(child, dict) else None
    body = {k: v for k, v in child.items() if k != "`$KEY`"} if isinstance(child, dict) else child
    if isinstance(body, dict) and set(body) == {"`$VAL`"}:
        body = body["`$VAL`"]

    def entry(x: Column, i: Column) -> Column:
        inner = _inside(source, node(x), key(x, i), cx)
        if name is None:
            k = key(x, i)
        elif "`" in name:
            k = _text(compile_spec(name, inner))
        else:
            k = inner.here.path(paths.resolve(name)).text()
        return F.struct(k.alias("key"), _column(compile_spec(body, inner)).alias("value"))

    entries = F.filter(F.transform(array, entry), lambda e: e["key"].isNotNull() & (e["key"] != ""))
    return F.map_from_entries(entries)  # of equal keys the last stays: spark.sql.mapKeyDedupPolicy, which transform() sets


def _text(x) -> Column:
    return x.text() if isinstance(x, Node) else x.cast("string")


def _column(x) -> Column:
    return F.lit(None) if x is DROP else x.column if isinstance(x, Node) else x


def _subspec(path: str, cx: Context):
    spec = cx.spec
    for s in paths.resolve(path) or []:
        spec = spec.get(s) if isinstance(spec, dict) else spec[int(s)] if isinstance(spec, list) and s.isdigit() and int(s) < len(spec) else None
        if spec is None:
            return None
    return spec


def compile_spec(spec, cx: Context):
    """A Column, a Node (kept typed) or DROP."""
    if isinstance(spec, dict):
        fields = compile_map(spec, cx)
        if isinstance(fields, Column):
            return fields
        return F.struct(*(c.alias(k) for k, c in fields.items())) if fields else F.struct()
    if isinstance(spec, (list, tuple)):
        head = _FULL.fullmatch(spec[0]) if spec and isinstance(spec[0], str) else None
        name = head[1] if head else ""
        if name == "$EACH":
            return _each(spec[1], spec[2], cx)
        if name == "$FORMAT":
            return _format(spec[1], spec[2], cx)
        if name == "$APPLY":
            if not callable(spec[1]):
                raise ValueError(f"$APPLY: invalid argument: {spec[1]} ({kinds.NAMES[kinds.T_string]} at position 1) is not of type: function.")
            return spec[1](_column(compile_spec(spec[2], cx)))
        if name == "$REF":
            return _again(spec[1], cx)
        places = [cx.slot().down(str(i)) if isinstance(x, dict) else replace(cx.slot(), step=str(i)) for i, x in enumerate(spec)]
        made = [_modified(compile_spec(x, at), x, str(i), at) for i, (x, at) in enumerate(zip(spec, places, strict=True))]
        made = [m for m in made if m is not DROP and not (isinstance(m, Node) and m.absent)]
        kinds_of = {m.kind.simpleString() if isinstance(m, Node) and m.kind else _TYPES.get(type(s), type(s).__name__) for m, s in zip(made, spec, strict=False)}
        if len(kinds_of) <= 1:
            return F.array(*map(_column, made))
        return F.array(*(m.as_variant() if isinstance(m, Node) else nodes.as_variant(m) for m in made))
    if isinstance(spec, str):
        return _leaf(spec, cx)
    return F.lit(spec)


def _again(path: str, cx: Context):
    """`$REF`: a part of the spec once more, in this place; one that refers on ends where the data ends."""
    sub = _subspec(path, cx)
    if sub is None or sub == ["`$REF`", path]:
        return DROP
    own = cx.slot()
    if has_ref(sub):
        if own.here.absent:
            return DROP
        if own.here.is_variant:
            return _unrolled(path, sub, own)
        if len(cx.going) > 32:
            raise ValueError("a $REF that refers to itself needs data of a fixed depth")
    inner = replace(own if isinstance(sub, (dict, list)) and not _is_command(sub) else cx, going=(*cx.going, path))
    made = compile_spec(sub, inner)
    return F.when(~own.here.missing(), _column(made)) if has_ref(sub) and made is not DROP else made


_LOAD = "struct<data:variant,done:variant,many:boolean>"


def _unrolled(path: str, sub, cx: Context) -> Column:
    """A part of the spec that refers to itself, over VARIANT: one copy of it, applied level by level as deep as the data goes (VARIANT).

    Its fields can refer to it by `$REF`, or for each element of what stands in the same place (`$EACH` of "." with `$REF`).
    """
    again = ["`$REF`", path]
    if not isinstance(sub, dict) or any(has_ref(v) and v not in (again, ["`$EACH`", ".", again]) for v in sub.values()) or re.search(r"`\.\.|`\$(PACK|MERGE)", json.dumps(sub, default=str)):
        raise ValueError("over VARIANT only fields can refer to the part they are in, and none to what is above it: see trees.transform_udf")
    plain = {k: v for k, v in sub.items() if not has_ref(v)}
    null = F.lit(None).cast("variant")

    def load(data: Column, done: Column, many: bool) -> Column:
        return F.struct(data.alias("data"), done.alias("done"), F.lit(many).alias("many")).cast(_LOAD)

    def fields(data: Column, key: Column) -> Column:
        inner = replace(cx, here=Node.variant(data), above=(), step=None, key=F.coalesce(key, cx.key) if cx.key is not None else key, going=(*cx.going, path))
        made = [(k, load(null, c if isinstance(plain[k], str) and _is_variant(plain[k], inner) else F.when(c.isNotNull(), nodes.as_variant(c)), False)) for k, c in compile_map(plain, inner).items()]
        made += [(k, load(kinds.present(nodes.lookup(data, k)), null, v != again)) for k, v in sub.items() if has_ref(v)]
        pairs = F.array(*(F.struct(F.lit(k).alias("key"), x.alias("load")) for k, x in made))
        return F.filter(pairs, lambda p: p["load"]["data"].isNotNull() | p["load"]["done"].isNotNull())

    def expand(key: Column, x: Column, parent: Column, at: Column) -> Column:
        elements = F.transform(nodes.items(x["data"]), lambda e: F.struct(e["key"].alias("key"), load(e["value"], null, False).alias("load")))
        kids = F.when(x["done"].isNotNull(), F.array().cast(f"array<struct<key:string,load:{_LOAD}>>")).when(x["many"], elements).otherwise(fields(x["data"], key))
        return F.struct(F.when(x["done"].isNotNull(), "scalar").when(x["many"], "list").otherwise("map").alias("kind"), x["done"].alias("value"), kids.alias("kids"))

    return F.when(~cx.here.missing(), by_levels(load(cx.here.column, null, False), _LOAD, expand, None, 2 * MAXDEPTH))


def _is_variant(spec: str, cx: Context) -> bool:
    made = compile_spec(spec, cx)
    return isinstance(made, Node) and made.is_variant


def compile_map(spec: dict, cx: Context) -> dict[str, Column] | Column:
    """Fields of a map template in order; a Column for `$PACK`."""
    if "`$PACK`" in spec:
        return _pack(spec["`$PACK`"], cx)
    out: dict[str, Column] = {}
    cx = replace(cx, field=spec["`$KEY`"] if isinstance(spec.get("`$KEY`"), str) else None)
    for k, v in spec.items():
        if _FULL.fullmatch(k) and k.startswith("`$"):
            continue
        step = re.sub(r"^`|`$", "", k)
        inner = cx.down(step, step=None, key=F.lit(step)) if isinstance(v, dict) and not _is_command(v) else replace(cx, step=step)
        made = _modified(compile_spec(v, inner), v, step, inner)
        if made is not DROP and not (isinstance(made, Node) and made.absent):
            out[k] = _column(made)
    merges = sorted(k for k in spec if re.fullmatch(r"`\$MERGE\d*`", k))
    for k in merges:  # what is there already wins
        args = spec[k] if isinstance(spec[k], list) else [spec[k]]
        made = [cx.root if a in ("", "``") else compile_spec(a, replace(cx, step=None)) for a in args]
        if any(isinstance(m, Node) and (m.is_variant or isinstance(m.kind, MapType)) for m in made):
            return _merged(out, made)
        for a, node in zip(reversed(args), reversed(made), strict=True):
            if isinstance(node, Node) and isinstance(node.kind, StructType):
                for f in node.kind.fields:
                    out.setdefault(f.name, node.get(f.name).column)
            elif isinstance(a, dict):
                for name, c in compile_map(a, cx).items():
                    out.setdefault(name, c)
            elif not (node is DROP or isinstance(node, Node) and node.absent):
                raise ValueError("$MERGE: needs a map")
    return out


def _merged(fields: dict[str, Column], args: list) -> Column:
    """Maps whose keys only the data knows, under the fields, merged to any depth: VARIANT."""
    maps = [m.as_variant() if isinstance(m, Node) else nodes.as_variant(m) for m in args if m is not DROP]
    own = F.to_variant_object(F.struct(*(c.alias(k) for k, c in fields.items()))) if fields else F.parse_json(F.lit("{}"))
    return merge_variants([*maps, own])


def _is_command(v) -> bool:
    return isinstance(v, list) and bool(v) and isinstance(v[0], str) and v[0].startswith("`$") or isinstance(v, dict) and "`$PACK`" in v


def transform(df: DataFrame, spec: dict, doc: str | None = None, extra: dict[str, Callable] | None = None, meta: dict | None = None, modify: Callable | None = None, handler: Callable | None = None) -> DataFrame:
    """One column for each key of spec, from each row (or from the document in column doc).

    modify(leaf, key, context) and handler(value, reference, context) see and replace values as Node; both run while the template is compiled.
    """
    if wrong := misplaced(spec, extra or ()):
        raise ValueError(" | ".join(wrong))
    df.sparkSession.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    root = Node.row(df) if doc is None else Node(F.col(doc), df.schema[doc].dataType)
    fields = compile_map(spec, Context(root, root, spec, extra=extra or {}, meta=meta or {}, modify=modify, handler=handler))
    if isinstance(fields, Column):
        raise ValueError("a $PACK or a $MERGE of VARIANT has no fixed columns: put it under a key")
    return df.select(*(c.alias(k) for k, c in fields.items()))


def inject(template, df: DataFrame, modify: Callable | None = None, handler: Callable | None = None) -> Column:
    """A template over the row as one column: text, a map (nested row) or a list (array)."""
    root = Node.row(df)
    cx = Context(root, root, template, modify=modify, handler=handler)
    if isinstance(template, (dict, list, tuple)):
        return _column(compile_spec(template, cx))
    return _column(_modified(_leaf(template, cx), template, "", cx) if isinstance(template, str) else F.lit(template))
