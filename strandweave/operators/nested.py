"""Deeply nested records as related flat tables, by shared inlining.

`schema_graph` walks a Spark schema as a graph: an edge to a struct field is "one", to an array or map element "many".
`shred` then inlines every descendant that is reached by "one" edges only, makes a table for each "many" element, and lets
struct types that occur below several parents share one table, told apart by `parent_table`. A child row holds the
key of the root record and the position at each level, so its key and its parent's key are prefixes of each other. Spark schemas are
finite, so recursive types arrive here already unrolled; a self-similar struct is shared like any other.

Cases: null or empty arrays give no child row; a null element gives none either but keeps its position (from 1); parents carry
the number of non-null children; a map becomes a table of entry_key and value; rows with a null key are dropped; repeated
rows of a key are one record (`distinct_on`). Inlined names are joined by `_`, and a name that is taken gets a number, so
clashing names do no harm.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class Node:
    """A table to be: the path from its parent, its element type, inlined columns and children."""

    name: str
    source: tuple[str, ...]
    dtype: T.DataType
    level: int
    is_map: bool = False
    inlined: list[tuple[str, tuple[str, ...]]] = field(default_factory=list)
    children: list["Node"] = field(default_factory=list)

    def walk(self):
        yield self
        for c in self.children:
            yield from c.walk()


def schema_graph(schema: T.StructType, root: str) -> Node:
    """The tree of tables for a schema: which fields are inlined, which become tables."""
    node = Node(root, (), schema, 0)
    _fill(node, schema, ())
    return node


def _fill(node: Node, st: T.StructType, path: tuple[str, ...]) -> None:
    taken = {n for n, _ in node.inlined}
    for f in st.fields:
        p = (*path, f.name)
        if isinstance(f.dataType, T.StructType):
            _fill(node, f.dataType, p)
            taken = {n for n, _ in node.inlined}
        elif isinstance(f.dataType, (T.ArrayType, T.MapType)):
            is_map = isinstance(f.dataType, T.MapType)
            elem = f.dataType.valueType if is_map else f.dataType.elementType
            child = Node(f"{node.name}__{'_'.join(p)}", p, elem, node.level + 1, is_map)
            if isinstance(elem, T.StructType):
                _fill(child, elem, ())
            elif isinstance(elem, T.ArrayType):
                child.children.append(_nested_list(child, elem))
            else:
                child.inlined.append(("value", ()))
            node.children.append(child)
        else:
            name, k = "_".join(p), 2
            while name in taken:
                name, k = f"{'_'.join(p)}_{k}", k + 1
            taken.add(name)
            node.inlined.append((name, p))


def _nested_list(parent: Node, t: T.ArrayType) -> Node:
    child = Node(f"{parent.name}__item", (), t.elementType, parent.level + 1)
    if isinstance(t.elementType, T.StructType):
        _fill(child, t.elementType, ())
    elif isinstance(t.elementType, T.ArrayType):
        child.children.append(_nested_list(child, t.elementType))
    else:
        child.inlined.append(("value", ()))
    return child


def _get(c: Column, path: tuple[str, ...]) -> Column:
    for p in path:
        c = c.getField(p)
    return c


def shared_types(root: Node) -> dict[str, str]:
    """Tables whose struct type occurs below several parents: each table's name -> the name they share."""
    by: dict[str, list[str]] = {}
    for n in root.walk():
        if n.level and isinstance(n.dtype, T.StructType):
            by.setdefault(n.dtype.simpleString(), []).append(n.name)
    return {name: min(names, key=lambda x: (x.count("__"), x)) for names in by.values() if len(names) > 1 for name in names}


def shred(df: DataFrame, key: str, root: str, distinct_on: bool = True) -> dict[str, DataFrame]:
    """{table: rows}. Root rows: key, inlined columns, n_<list> counts. Child rows: key, pos_1..pos_n, inlined columns,
    n_<list> counts, parent_table. (key, pos_1..pos_n) is the child's key, the same without its last part its parent's."""
    rec = F.struct(*[F.col(f"`{f.name}`").alias(f.name) for f in df.schema.fields if f.name != key])
    base = df.where(F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").alias(key), rec.alias("__e"))
    graph = schema_graph(T.StructType([f for f in df.schema.fields if f.name != key]), root)
    out: dict[str, list[DataFrame]] = {}
    shared = shared_types(graph)
    _emit(graph, base, [key], None, out, shared, distinct_on)
    done = {}
    for name, parts in out.items():
        d = parts[0]
        for p in parts[1:]:
            d = d.unionByName(p, allowMissingColumns=True)
        done[name] = d
    return done


def _emit(node: Node, rows: DataFrame, keys: list[str], parent: str | None, out: dict, shared: dict, distinct_on: bool) -> None:
    cols = [F.col(k) for k in keys] + ([F.lit(parent).alias("parent_table")] if parent else [])
    names = set(keys) | {"parent_table"}
    if node.is_map:
        cols.append(F.col("__k").alias("entry_key"))
        names.add("entry_key")
    for n, p in node.inlined:
        while n in names:
            n += "_"
        names.add(n)
        cols.append(_get(F.col("__e"), p).alias(n))
    for c in node.children:
        a = _get(F.col("__e"), c.source)
        n = F.size(F.filter(F.map_values(a) if c.is_map else a, lambda x: x.isNotNull()))
        label = f"n_{'_'.join(c.source) or 'item'}"
        while label in names:
            label += "_"
        names.add(label)
        cols.append(F.when(a.isNull(), 0).otherwise(n).alias(label))
    flat = rows.select(*cols)
    out.setdefault(shared.get(node.name, node.name), []).append(flat.dropDuplicates(keys) if distinct_on else flat)
    for c in node.children:
        pos = f"pos_{c.level}"
        a = _get(F.col("__e"), c.source)
        if c.is_map:
            sub = rows.select(*keys, F.posexplode(a).alias("__p", "__k", "__v"))
            sub = sub.select(*keys, (F.col("__p") + 1).alias(pos), "__k", F.col("__v").alias("__e"))
        else:
            sub = rows.select(*keys, F.posexplode(a).alias("__p", "__v"))
            sub = sub.select(*keys, (F.col("__p") + 1).alias(pos), F.col("__v").alias("__e"))
        _emit(c, sub.where(F.col("__e").isNotNull()), [*keys, pos], node.name, out, shared, distinct_on)
