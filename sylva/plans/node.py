"""A document value while a spec is compiled: a typed column, a VARIANT column, or nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DataType, DateType, MapType, NumericType, StringType, StructType, TimestampNTZType, TimestampType, VariantType

from ..functions import kinds, nodes
from ..functions.nodes import _INDEX, _key


class Node:
    """col with its type; a None type is an absent value. Typed columns have no null apart from absent."""

    def __init__(self, col: Column | None, kind: DataType | None, fields: dict[str, Column] | None = None):
        self.col, self.kind, self.fields = col, kind, fields
        self.base, self.steps = col, "$"  # col of a VARIANT as one read from a column

    @classmethod
    def row(cls, df: DataFrame) -> Node:
        """The row itself as a map; reads stay plain columns, so that filters and projections reach the scan."""
        return cls(None, df.schema, {f.name: F.col(f"`{f.name}`") for f in df.schema.fields})

    @classmethod
    def variant(cls, col: Column) -> Node:
        return cls(col, VariantType())

    @property
    def absent(self) -> bool:
        return self.kind is None

    @property
    def column(self) -> Column:
        if self.absent:
            return F.lit(None)
        if self.col is None:
            return F.struct(*(c.alias(k) for k, c in self.fields.items()))
        return self.col

    @property
    def is_variant(self) -> bool:
        return isinstance(self.kind, VariantType)

    def get(self, key: str | int | float) -> Node:
        """The value at a key; of VARIANT null and absent are not told apart."""
        k = _key(key)
        t = self.kind
        if isinstance(t, StructType):
            field = next((f for f in t.fields if f.name == k), None)
            if field is None:
                return ABSENT
            return Node(self.fields[k] if self.fields is not None else self.col.getField(k), field.dataType)
        if isinstance(t, MapType):
            return Node(F.try_element_at(self.col, F.lit(k)), t.valueType)
        if isinstance(t, ArrayType):
            return Node(F.get(self.col, F.lit(int(k))), t.elementType) if _INDEX.fullmatch(k) else ABSENT
        if self.is_variant:
            return Node(nodes.getprop(self.col, k), t)
        return ABSENT

    def child(self, key: str | int, listed: bool = False) -> Node:
        """The value at a map's key or (listed) at a list's index; of VARIANT null is kept, and the read stays one expression at any depth."""
        if not self.is_variant:
            return self.get(key)
        k = _key(key)
        if k == "" or listed and not _INDEX.fullmatch(k):
            return ABSENT
        if '"' in k or "\\" in k:
            return Node.variant(F.try_element_at(F.try_variant_get(self.col, "$", "map<string,variant>"), F.lit(k)))
        steps = self.steps + (f"[{k}]" if listed else f'["{k}"]')
        out = Node.variant(F.variant_get(self.base, steps, "variant"))
        out.base, out.steps = self.base, steps
        return out

    def at(self, key: Column) -> Node:
        """The value at a key that is text of the row."""
        t, index = self.kind, F.when(key.rlike(f"^({_INDEX.pattern})$"), key.try_cast("int"))
        if isinstance(t, StructType):
            same = [f for f in t.fields if f.dataType == t.fields[0].dataType]
            if len(same) < len(t.fields):
                raise ValueError("a key that depends on the row needs fields of one type")
            return Node(F.coalesce(*(F.when(key == f.name, self.get(f.name).column) for f in same)), same[0].dataType) if same else ABSENT
        if isinstance(t, MapType):
            return Node(F.try_element_at(self.col, key), t.valueType)
        if isinstance(t, ArrayType):
            return Node(F.get(self.col, index), t.elementType)
        if self.is_variant:
            return Node(kinds.present(F.coalesce(F.try_element_at(kinds.as_map(self.col), key), F.get(kinds.as_list(self.col), index))), t)
        return ABSENT

    def path(self, steps: list[str] | None) -> Node:
        out = ABSENT if steps is None else self
        for s in steps or []:
            out = out.get(s)
        return out

    def missing(self) -> Column:
        if self.absent:
            return F.lit(True)
        return kinds.is_missing(self.col) if self.is_variant else self.column.isNull()

    def is_kind(self, bits: int) -> Column:
        """Whether the value has all of these type bits (one of the composite codes)."""
        if self.absent:
            return F.lit(False)
        if self.is_variant:
            test = {kinds.MAP: kinds.ismap, kinds.LIST: kinds.islist, kinds.STRING: kinds.is_string, kinds.BOOLEAN: kinds.is_boolean, kinds.T_number: kinds.is_number}.get(bits)
            return test(self.col) if test else F.coalesce(kinds.typify(self.col) == bits, F.lit(False))
        t, there = self.kind, self.column.isNotNull()
        if isinstance(t, NumericType):
            if bits == kinds.T_number:
                return there
            whole = F.coalesce(self.col % 1 == 0, F.lit(False))
            return whole if bits == kinds.INTEGER else there & ~whole if bits == kinds.DECIMAL else F.lit(False)
        own = kinds.STRING if isinstance(t, (StringType, DateType, TimestampType, TimestampNTZType, BinaryType)) else kinds.BOOLEAN if isinstance(t, BooleanType) else kinds.MAP if isinstance(t, (StructType, MapType)) else kinds.LIST if isinstance(t, ArrayType) else 0
        return there if bits == own else F.lit(False)

    def number(self) -> Column:
        if self.is_variant:
            return kinds.number(self.col)
        return self.col.cast("double") if isinstance(self.kind, NumericType) else F.lit(None).cast("double")

    def string(self) -> Column:
        if self.is_variant:
            return kinds.string(self.col)
        return self.col if isinstance(self.kind, StringType) else F.lit(None).cast("string")

    def text(self) -> Column:
        """Human text; absent is NULL."""
        if self.absent:
            return F.lit(None).cast("string")
        if self.is_variant:
            return kinds.text(self.col)
        if isinstance(self.kind, NumericType):
            return kinds.number_text(self.col.cast("double"))
        if isinstance(self.kind, (StructType, MapType, ArrayType)):
            return F.to_json(self.column)
        return self.col.cast("string")

    def as_variant(self) -> Column:
        if self.absent:
            return F.lit(None).cast("variant")
        return self.col if self.is_variant else nodes.as_variant(self.column)


ABSENT = Node(None, None)


def typecode(value) -> int:
    """Type bits of a spec's literal."""
    if value is None:
        return kinds.NULL
    if isinstance(value, bool):
        return kinds.BOOLEAN
    if isinstance(value, (int, float)):
        return kinds.INTEGER if float(value).is_integer() else kinds.DECIMAL
    if isinstance(value, str):
        return kinds.STRING
    if isinstance(value, dict):
        return kinds.MAP
    return kinds.LIST if isinstance(value, (list, tuple)) else kinds.T_function | kinds.T_scalar


def equals(node: Node, value) -> Column:
    """Same type and equal to a literal scalar; pushed to the scan where the column has the type already."""
    if node.absent:
        return F.lit(value is None)
    if value is None:
        return node.missing()
    if isinstance(value, bool):
        if node.is_variant:
            return F.coalesce(kinds.boolean(node.col) == value, F.lit(False))
        return node.col == value if isinstance(node.kind, BooleanType) else F.lit(False)
    if isinstance(value, (int, float)):
        if node.is_variant:
            return F.coalesce(kinds.number(node.col) == float(value), F.lit(False))
        return node.col == value if isinstance(node.kind, NumericType) else F.lit(False)
    if node.is_variant:
        return F.coalesce(kinds.string(node.col) == value, F.lit(False))
    return node.col == value if isinstance(node.kind, StringType) else F.lit(False)
