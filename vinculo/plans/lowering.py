"""From a syntax tree to a DataFrame over a graph.

Variables are columns of one flat frame: a node ``c`` has ``c$id`` and ``c$<property>`` for the properties the query
mentions, an edge the same, a value just its name. A node of whom nothing but its identity is asked is taken from the
edge and its table isn't read. Joins are plain equi-joins, so Catalyst orders them and picks their kind by size.
Where a MATCH goes straight into counts, an edge at the end of a pattern that nothing else names isn't expanded: rows
carry how many such edges there are, less those the MATCH uses already.

Kept from the language: an edge is used once in a MATCH; nodes are told apart by identity, not by name; items without
an aggregate are the grouping keys; null sorts as the largest value; lists of ``collect`` have no nulls. Added: the
lists are sorted, so results don't depend on the order of rows.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import Graph
from . import syntax as S
from .tokens import QueryError

MAX_RESULTS = 50


@dataclass(frozen=True)
class Binding:
    """What a variable is: ``node`` or ``edge`` with its labels or types, or ``value``."""

    kind: str
    labels: tuple = ()


class Lowering:
    def __init__(self, graph: Graph, params: dict | None = None):
        self.graph = graph
        self.params = params or {}
        self.frame: DataFrame | None = None
        self.scope: dict[str, Binding] = {}
        self.asked: dict[str, set[str]] = {}
        self.whole: set[str] = set()
        self.named: Counter[str] = Counter()
        self.hidden = 0
        # whether the MATCH at hand goes into counts and has rows before it, its edges to count, and the column of how many matches a row stands for
        self.counted = False
        self.joined = False
        self.ends: list[tuple[str, Column, Column, tuple, DataFrame]] = []
        self.weight: str | None = None

    # entry

    def run(self, query: S.Query) -> DataFrame:
        self._usage(query)
        for clause, then in zip(query.clauses, [*query.clauses[1:], None]):
            if isinstance(clause, S.Match):
                self.counted = not clause.optional and isinstance(then, S.Projection) and _counts(then)
                self._match(clause)
            else:
                self._project(clause)
        return self.frame

    def _usage(self, query: S.Query) -> None:
        """Which properties of which variables the query mentions; WITH may rename variables, names are shared."""
        for x in query.walk():
            if isinstance(x, S.Variable):
                self.named[x.name] += 1
            elif isinstance(x, (S.NodePattern, S.EdgePattern)) and x.variable:
                self.named[x.variable] += 1
            if isinstance(x, S.Property) and isinstance(x.owner, S.Variable):
                self.asked.setdefault(x.owner.name, set()).add(x.name)
            elif isinstance(x, (S.NodePattern, S.EdgePattern)) and x.variable:
                self.asked.setdefault(x.variable, set()).update(x.properties)
            elif isinstance(x, S.Call) and x.name == "properties":
                self.whole.update(a.name for a in x.args if isinstance(a, S.Variable))
        for x in query.walk():
            if isinstance(x, S.Item) and isinstance(x.expr, S.Variable):
                self.asked.setdefault(x.expr.name, set()).update(self.asked.get(x.alias, ()))
        self.whole.update(i.expr.name for i in query.result.items if isinstance(i.expr, S.Variable))

    # matching

    def _hide(self) -> str:
        self.hidden += 1
        return f"_{self.hidden}"

    def _node_label(self, pattern: S.Pattern, i: int) -> tuple:
        """The labels a node may have: its own, its variable's, or those that the edges beside it allow."""
        node = pattern.nodes[i]
        if node.label:
            known = {x.casefold(): x for x in self.graph.nodes}
            label = known.get(node.label.casefold(), node.label)
            self.graph.node(label)
            return (label,)
        if node.variable in self.scope:
            return self.scope[node.variable].labels
        found: set | None = None
        for j, side in ((i - 1, 1), (i, 0)):
            if 0 <= j < len(pattern.edges):
                edge = pattern.edges[j]
                own: set = set()
                for kind in self._edge_types(edge):
                    ends = self.graph.endpoint_labels(kind)
                    own |= set(ends) if edge.direction == "-" else {ends[side if edge.direction == ">" else 1 - side]}
                found = own if found is None else found & own
        return tuple(sorted(found)) if found is not None else tuple(sorted(self.graph.nodes))

    def _edge_types(self, edge: S.EdgePattern) -> tuple:
        known = {x.casefold(): x for x in self.graph.types}
        for kind in edge.types:
            if kind.casefold() not in known:
                raise QueryError(f"unknown edge type {kind}")
        return tuple(known[k.casefold()] for k in edge.types) or tuple(sorted(self.graph.types))

    def _scan_nodes(self, variable: str, labels: tuple) -> DataFrame:
        asked = self.asked.get(variable, set())
        parts = []
        for label in labels:
            table = self.graph.node(label)
            names = [c for c in table.columns if c != "node_id" and (c in asked or variable in self.whole)]
            parts.append(table.select(F.col("node_id").alias(f"{variable}$id"), *([F.lit(label).alias(f"{variable}$label")] if len(labels) > 1 else []), *[F.col(f"`{c}`").alias(f"{variable}${c}") for c in names]))
        return _union(parts)

    def _scan_edges(self, variable: str, edge: S.EdgePattern) -> DataFrame:
        asked = self.asked.get(edge.variable or "", set())
        parts = []
        for kind in self._edge_types(edge):
            table = self.graph.edge(kind)
            names = [c for c in table.columns if c not in ("edge_id", "src", "dst") and (c in asked or edge.variable in self.whole)]
            ends = [("src", "dst")] if edge.direction != "-" else [("src", "dst"), ("dst", "src")]
            labels = self.graph.endpoint_labels(kind)
            for a, b in ends:
                la, lb = labels if a == "src" else labels[::-1]
                one = table.where("src <> dst") if (a, b) == ("dst", "src") and la == lb else table
                parts.append(one.select(F.col("edge_id").alias(f"{variable}$id"), F.lit(kind).alias(f"{variable}$type"), F.col(a).alias(f"{variable}$a"), F.col(b).alias(f"{variable}$b"), F.lit(la).alias(f"{variable}$la"), F.lit(lb).alias(f"{variable}$lb"), *[F.col(f"`{c}`").alias(f"{variable}${c}") for c in names]))
        return _union(parts)

    def _match(self, clause: S.Match) -> None:
        if clause.optional and self.frame is not None:
            return self._optional(clause)
        used: list[tuple[str, tuple]] = []
        self.joined = self.frame is not None
        for pattern in clause.patterns:
            self._pattern(pattern, used)
        for (a, ta), (b, tb) in combinations(used, 2):
            if set(ta) & set(tb):
                same = F.col(f"`{a}$id`") == F.col(f"`{b}$id`")
                if len(ta) > 1 or len(tb) > 1:
                    same = same & (F.col(f"`{a}$type`") == F.col(f"`{b}$type`"))
                self.frame = self.frame.where(~same)
        if clause.where is not None:
            self.frame = self.frame.where(self._expr(clause.where))
        self._count_ends(used)

    def _count_ends(self, used: list) -> None:
        """Rows get the number of edges at the ends put aside; an edge that a row uses already isn't one of them."""
        for here, near, edge_id, types, table in self.ends:
            key, n, product = (self._hide() for _ in range(3))
            self.frame = self.frame.join(table.groupBy(near.alias(key)).agg(F.count("*").alias(n)), F.col(f"`{here}$id`") == F.col(key))
            left = F.col(n)
            for e, own in used:
                if set(own) & set(types):
                    key, i, n = (self._hide() for _ in range(3))
                    same = (F.col(f"`{here}$id`") == F.col(key)) & (F.col(f"`{e}$id`") == F.col(i))
                    if len(own) > 1:
                        same = same & (F.col(f"`{e}$type`") == types[0])
                    self.frame = self.frame.join(table.groupBy(near.alias(key), edge_id.alias(i)).agg(F.count("*").alias(n)), same, "left")
                    left = left - F.coalesce(F.col(n), F.lit(0))
            self.frame = self.frame.withColumn(product, left if self.weight is None else F.col(self.weight) * left).where(F.col(product) > 0)
            self.weight = product
        self.ends = []

    def _is_end(self, edge: S.EdgePattern, node: S.NodePattern) -> bool:
        """Whether only the number of such edges matters: nothing else names them, and none of the same type is put aside."""
        unnamed = all(x.variable is None or self.named[x.variable] == 1 for x in (edge, node)) and not edge.properties and not node.properties
        types = self._edge_types(edge)
        return unnamed and len(types) == 1 and not any(set(types) & set(other) for *_, other, _ in self.ends)

    def _pattern(self, pattern: S.Pattern, used: list) -> None:
        names = [n.variable or self._hide() for n in pattern.nodes]
        labels = [self._node_label(pattern, i) for i in range(len(names))]
        bound = next((i for i, n in enumerate(names) if n in self.scope), None)
        if bound is None:
            outer, self.frame = self.frame, self._scan_nodes(names[0], labels[0])
            self._bind(names[0], labels[0])
            bound = 0
        else:
            outer = None
            if self.scope[names[bound]].kind != "node":
                raise QueryError(f"{names[bound]} isn't a node")
        self._properties(names[bound], pattern.nodes[bound].properties)
        for j in [*range(bound, len(pattern.edges)), *range(bound - 1, -1, -1)]:
            forward = j >= bound
            here, there = (j, j + 1) if forward else (j + 1, j)
            self._expand(pattern, j, names, labels, here, there, forward, used)
        if outer is not None:
            self.frame = outer.crossJoin(self.frame)

    def _expand(self, pattern, j, names, labels, here, there, forward, used) -> None:
        edge = pattern.edges[j]
        e = edge.variable or self._hide()
        if e in self.scope:
            raise QueryError(f"the edge {e} is bound twice")
        table = self._scan_edges(e, edge)
        near, far = ("a", "b") if (edge.direction in (">", "-")) == forward else ("b", "a")
        conditions = [F.col(f"`{names[here]}$id`") == F.col(f"`{e}${near}`")]
        one = len(self._edge_types(edge)) == 1 and (edge.direction != "-" or len(set(self.graph.endpoint_labels(self._edge_types(edge)[0]))) == 1)
        if not one:
            own = self.scope[names[here]].labels
            conditions.append(self._label_of(names[here]) == F.col(f"`{e}$l{near}`") if len(own) > 1 else F.col(f"`{e}$l{near}`") == own[0])
        n, other = names[there], F.col(f"`{e}${far}`")
        ends = {self.graph.endpoint_labels(k)[1 if far == "b" else 0] for k in self._edge_types(edge)} if edge.direction != "-" else {x for k in self._edge_types(edge) for x in self.graph.endpoint_labels(k)}
        unread = not self.asked.get(n) and n not in self.whole and len(labels[there]) == 1 and ends == set(labels[there])
        # the first edge alone gives no more rows than there are edges
        if self.counted and (used or self.joined) and there in (0, len(names) - 1) and n not in self.scope and one and unread and self._is_end(edge, pattern.nodes[there]):
            self.ends.append((names[here], F.col(f"`{e}${near}`"), F.col(f"`{e}$id`"), self._edge_types(edge), table))
            return
        self.frame = self.frame.join(table, conditions[0] if len(conditions) == 1 else conditions[0] & conditions[1])
        self.scope[e] = Binding("edge", self._edge_types(edge))
        used.append((e, self._edge_types(edge)))
        self._properties(e, edge.properties)
        if n in self.scope:
            self.frame = self.frame.where(F.col(f"`{n}$id`") == other)
            if not one and len(self.scope[n].labels) > 1:
                self.frame = self.frame.where(self._label_of(n) == F.col(f"`{e}$l{far}`"))
        else:
            if unread:
                self.frame = self.frame.withColumn(f"{n}$id", other)
            else:
                nodes = self._scan_nodes(n, labels[there])
                on = other == F.col(f"`{n}$id`")
                if len(labels[there]) > 1:
                    on = on & (F.col(f"`{n}$label`") == F.col(f"`{e}$l{far}`"))
                elif len(ends) > 1:
                    on = on & (F.col(f"`{e}$l{far}`") == labels[there][0])
                self.frame = self.frame.join(nodes, on)
            self._bind(n, labels[there])
        self._properties(n, pattern.nodes[there].properties)

    def _label_of(self, n: str) -> Column:
        return F.col(f"`{n}$label`") if f"{n}$label" in self.frame.columns else F.lit(self.scope[n].labels[0])

    def _bind(self, name: str, labels: tuple) -> None:
        self.scope[name] = Binding("node", labels)

    def _properties(self, name: str, properties: dict) -> None:
        for key, value in properties.items():
            self.frame = self.frame.where(self._expr(S.Compare("=", S.Property(S.Variable(name), key), value)))

    def _optional(self, clause: S.Match) -> None:
        """The pattern by itself, with its own WHERE, joined to what is there on the nodes both know."""
        there = {v.variable for p in clause.patterns for v in p.nodes if v.variable in self.scope}
        outer, scope = self.frame, dict(self.scope)
        named = {x.name for x in clause.where.walk() if isinstance(x, S.Variable)} if clause.where else set()
        values = {v for v in named if v in scope and v not in there}
        if values:
            raise QueryError(f"WHERE of OPTIONAL MATCH may only name variables of its patterns, not {', '.join(sorted(values))}")
        self.frame, self.scope = None, {}
        keep = {n: scope[n] for n in there}
        labels = self._node_label
        self._node_label = lambda p, i: keep[p.nodes[i].variable].labels if p.nodes[i].variable in keep else labels(p, i)  # type: ignore[method-assign]
        self._match(S.Match(clause.patterns, clause.where, False))
        self._node_label = labels  # type: ignore[method-assign]
        inner, found = self.frame, self.scope
        new = [c for c in inner.columns if c.split("$")[0] not in there]
        if there:
            keys = {n: self._hide() for n in sorted(there)}
            inner = inner.select(*[F.col(f"`{n}$id`").alias(k) for n, k in keys.items()], *[F.col(f"`{c}`") for c in new])
            on = [F.col(f"`{n}$id`") == F.col(k) for n, k in keys.items()]
            joined = outer.join(inner, on, "left").drop(*keys.values())
        else:
            joined = outer.join(inner.select(*[F.col(f"`{c}`") for c in new]), F.lit(True), "left")
        self.frame, self.scope = joined, {**found, **scope}

    # projecting

    def _columns_of(self, name: str) -> list[str]:
        return [c for c in self.frame.columns if c.startswith(f"{name}$")]

    def _project(self, p: S.Projection) -> None:
        if self.frame is None:
            raise QueryError("a query must begin with MATCH")
        aggregated = any(S.has_aggregate(i.expr) for i in p.items)
        if aggregated:
            self._aggregate(p)
            order = [self._order(o, p, None) for o in p.order]
            self.frame = self.frame.orderBy(*order) if order else self.frame
        else:
            out, scope = [], {}
            for i in p.items:
                out += self._item(i, scope, p.final)
            extra = []
            order = []
            for o in p.order:
                known = self._alias_of(o.expr, p)
                if known is None and p.distinct:
                    raise QueryError("with DISTINCT, ORDER BY may only name what is returned")
                if known is None:
                    name = self._hide()
                    extra.append(self._expr(o.expr).alias(name))
                    order.append(_direction(F.col(name), o.descending))
                else:
                    order.append(_direction(known, o.descending))
            before = self.frame
            self.frame = before.select(*out, *extra)
            if p.distinct:
                keys = [i.alias for i in p.items]
                nodes = [f"{k}$id" for k in keys if f"{k}$id" in self.frame.columns]
                self.frame = self.frame.distinct() if not nodes else self.frame.dropDuplicates([c for c in self.frame.columns if "$" not in c or c in nodes or c.endswith("$label")])
            if order:
                self.frame = self.frame.orderBy(*order)
            if extra:
                self.frame = self.frame.drop(*[c for c in self.frame.columns if c.startswith("_") and c[1:].isdigit()])
            self.scope = scope
        if p.limit is not None:
            self.frame = self.frame.limit(p.limit)
        if p.where is not None:
            self.frame = self.frame.where(self._expr(p.where))

    def _item(self, i: S.Item, scope: dict, final: bool) -> list[Column]:
        """The columns of an item without an aggregate; in the result a node or an edge is one struct."""
        if isinstance(i.expr, S.Variable) and i.expr.name in self.scope and self.scope[i.expr.name].kind != "value":
            binding = self.scope[i.expr.name]
            columns = self._columns_of(i.expr.name)
            scope[i.alias] = binding
            if final:
                fields = [F.col(f"`{c}`").alias(c.split("$", 1)[1]) for c in columns if c.split("$", 1)[1] not in ("a", "b", "la", "lb")]
                return [F.when(F.col(f"`{i.expr.name}$id`").isNotNull(), F.struct(*fields)).alias(i.alias)]
            return [F.col(f"`{c}`").alias(f"{i.alias}${c.split('$', 1)[1]}") for c in columns]
        scope[i.alias] = Binding("value")
        return [self._expr(i.expr).alias(i.alias)]

    def _aggregate(self, p: S.Projection) -> None:
        keys, carried, aggregates, scope = [], [], [], {}
        names: list[str] = []
        for i in p.items:
            if S.has_aggregate(i.expr):
                scope[i.alias] = Binding("value")
                aggregates.append(self._expr(i.expr).alias(i.alias))
                names.append(i.alias)
                continue
            own = self._item(i, scope, False)
            if scope[i.alias].kind == "value":
                keys += own
                names.append(i.alias)
            else:
                # a node groups by its identity; what else is known of it comes along
                for c, column in zip(self._columns_of(i.expr.name), own):
                    part = c.split("$", 1)[1]
                    if part in ("id", "label", "type"):
                        keys.append(column)
                    else:
                        carried.append(F.first(F.col(f"`{c}`")).alias(f"{i.alias}${part}"))
                    names.append(f"{i.alias}${part}")
        grouped = self.frame.groupBy(*keys) if keys else self.frame
        self.frame = grouped.agg(*aggregates, *carried).select(*[F.col(f"`{n}`") for n in names])
        self.weight = None
        self.scope = scope
        if p.final:
            out = []
            for i in p.items:
                if self.scope[i.alias].kind == "value":
                    out.append(F.col(f"`{i.alias}`"))
                else:
                    out.append(F.struct(*[F.col(f"`{c}`").alias(c.split("$", 1)[1]) for c in self._columns_of(i.alias)]).alias(i.alias))
            self.frame = self.frame.select(*out)

    def _alias_of(self, expr: S.Node, p: S.Projection) -> Column | None:
        for i in p.items:
            if expr == i.expr or isinstance(expr, S.Variable) and expr.name == i.alias:
                if isinstance(i.expr, S.Variable) and self.scope.get(i.expr.name, Binding("value")).kind != "value":
                    return None
                return F.col(f"`{i.alias}`")
        return None

    def _order(self, o: S.Order, p: S.Projection, _) -> Column:
        known = self._alias_of(o.expr, p)
        if known is None:
            if S.has_aggregate(o.expr):
                raise QueryError("ORDER BY an aggregate needs that aggregate among the results")
            known = self._expr(o.expr)
        return _direction(known, o.descending)

    # expressions

    def _type(self, c: Column) -> T.DataType:
        return self.frame.select(c.alias("x")).schema["x"].dataType

    def _expr(self, x: S.Node, local: dict | None = None) -> Column:
        local = local or {}
        e = lambda y: self._expr(y, local)
        if isinstance(x, S.Literal):
            return F.lit(x.value)
        if isinstance(x, S.Parameter):
            if x.name not in self.params:
                raise QueryError(f"no value for ${x.name}")
            value = self.params[x.name]
            return F.array(*[F.lit(v) for v in value]) if isinstance(value, (list, tuple)) else F.lit(value)
        if isinstance(x, S.Variable):
            return self._variable(x.name, local)
        if isinstance(x, S.Property):
            return self._property(x, local)
        if isinstance(x, S.ListOf):
            return F.array(*[e(i) for i in x.items])
        if isinstance(x, S.Compare):
            return self._compare(x, local)
        if isinstance(x, S.Logic):
            out = e(x.parts[0])
            for part in x.parts[1:]:
                out = out & e(part) if x.op == "AND" else out | e(part)
            return out
        if isinstance(x, S.Not):
            return ~e(x.part)
        if isinstance(x, S.IsNull):
            return e(x.part).isNotNull() if x.negated else e(x.part).isNull()
        if isinstance(x, S.Arithmetic):
            return self._arithmetic(x, local)
        if isinstance(x, S.Case):
            out = F
            for condition, value in x.whens:
                out = out.when(e(condition), e(value))
            return out.otherwise(e(x.otherwise)) if x.otherwise is not None else out
        if isinstance(x, S.Quantifier):
            each = F.exists if x.kind == "any" else F.forall
            return each(e(x.source), lambda i: self._expr(x.condition, {**local, x.variable: i}))
        if isinstance(x, S.Slice):
            return self._slice(x, local)
        if isinstance(x, S.Call):
            return self._call(x, local)
        raise QueryError(f"can't lower {x}")

    def _variable(self, name: str, local: dict) -> Column:
        if name in local:
            return local[name]
        if name not in self.scope:
            raise QueryError(f"unknown variable {name}")
        return F.col(f"`{name}`") if self.scope[name].kind == "value" else F.col(f"`{name}$id`")

    def _property(self, x: S.Property, local: dict) -> Column:
        if isinstance(x.owner, S.Variable) and x.owner.name not in local:
            name = x.owner.name
            if name not in self.scope:
                raise QueryError(f"unknown variable {name}")
            if self.scope[name].kind == "value":
                return F.col(f"`{name}`")[x.name]
            column = f"{name}${x.name}"
            # a property that nothing of this label has is null
            return F.col(f"`{column}`") if column in self.frame.columns else F.lit(None).cast("string")
        return self._expr(x.owner, local)[x.name]

    def _compare(self, x: S.Compare, local: dict) -> Column:
        left, right = self._expr(x.left, local), self._expr(x.right, local)
        if x.op == "IN":
            if isinstance(x.right, S.ListOf) and all(isinstance(i, S.Literal) for i in x.right.items):
                return left.isin([i.value for i in x.right.items]) if x.right.items else F.lit(False)
            return F.array_contains(right, left)
        if x.op == "CONTAINS":
            return F.contains(left, right)
        if x.op == "STARTS":
            return F.startswith(left, right)
        if x.op == "ENDS":
            return F.endswith(left, right)
        if not local:
            text = [isinstance(self._type(c), T.StringType) for c in (left, right)]
            number = [isinstance(self._type(c), T.NumericType) for c in (left, right)]
            if (text[0] and number[1]) or (text[1] and number[0]):
                # values of different kinds are unequal and have no order
                unequal = F.when(left.isNotNull() & right.isNotNull(), F.lit(x.op == "<>"))
                return unequal if x.op in ("=", "<>") else F.lit(None).cast("boolean")
        return {"=": left == right, "<>": left != right, "<": left < right, ">": left > right, "<=": left <= right, ">=": left >= right}[x.op]

    def _arithmetic(self, x: S.Arithmetic, local: dict) -> Column:
        left, right = self._expr(x.left, local), self._expr(x.right, local)
        if x.op == "+" and not local and isinstance(self._type_or_none(left), (T.StringType, T.ArrayType)):
            return F.concat(left, right)
        if x.op == "/":
            whole = not local and all(isinstance(self._type_or_none(c), T.IntegralType) for c in (left, right))
            quotient = left / F.nullif(right, F.lit(0))
            return quotient.cast("long") if whole else quotient
        return {"+": left + right, "-": left - right, "*": left * right, "%": left % right}[x.op]

    def _type_or_none(self, c: Column):
        try:
            return self._type(c)
        except Exception:  # noqa: BLE001  an aggregate beside columns can't be analysed alone
            return None

    def _slice(self, x: S.Slice, local: dict) -> Column:
        source = self._expr(x.source, local)
        bounds = [b.value if isinstance(b, S.Literal) else None for b in (x.start, x.end)]
        if x.single:
            if bounds[0] is None:
                return F.get(source, self._expr(x.start, local))
            return F.get(source, F.lit(bounds[0])) if bounds[0] >= 0 else F.try_element_at(source, F.lit(bounds[0]))
        if (x.start is not None and bounds[0] is None) or (x.end is not None and bounds[1] is None) or any((b or 0) < 0 for b in bounds):
            raise QueryError("a slice needs whole numbers from 0")
        start = bounds[0] or 0
        return F.slice(source, start + 1, max(0, bounds[1] - start) if bounds[1] is not None else 2**31 - 1 - start)

    def _call(self, x: S.Call, local: dict) -> Column:
        name = x.name
        if name == "count":
            if x.distinct and not x.star:
                return F.count_distinct(self._counted(x.args[0], local))
            if self.weight is not None:
                weight = F.col(self.weight)
                return F.coalesce(F.sum(weight if x.star else F.when(self._counted(x.args[0], local).isNotNull(), weight)), F.lit(0))
            return F.count(F.lit(1) if x.star else self._counted(x.args[0], local))
        args = [self._expr(a, local) for a in x.args]
        if name == "collect":
            return F.sort_array((F.collect_set if x.distinct else F.collect_list)(args[0]))
        if name in ("sum", "avg", "min", "max"):
            if x.distinct and name in ("sum", "avg"):
                # one spelling of distinct aggregates that Catalyst knows for both
                return F.coalesce(F.sum_distinct(args[0]), F.lit(0)) if name == "sum" else F.sum_distinct(args[0]) / F.count_distinct(args[0])
            return {"sum": lambda c: F.coalesce(F.sum(c), F.lit(0)), "avg": F.avg, "min": F.min, "max": F.max}[name](args[0])
        if name in ("percentilecont", "percentiledisc", "median"):
            share = args[1] if len(args) == 2 else F.lit(0.5)
            if len(args) != (1 if name == "median" else 2):
                raise QueryError(f"{name} takes {1 if name == 'median' else 2} arguments")
            if x.distinct:
                raise QueryError(f"{name} takes no DISTINCT")
            if name == "percentiledisc":
                # a value that occurs; at this accuracy the summary is exact
                return F.percentile_approx(args[0], share, 2_000_000_000)
            return F.percentile(args[0], share)
        if name in ("labels", "type", "properties", "id", "elementid"):
            return self._about(name, x.args[0])
        simple = {
            "tolower": F.lower, "toupper": F.upper, "trim": F.trim, "ltrim": F.ltrim, "rtrim": F.rtrim, "abs": F.abs, "round": F.round, "size": F.size, "length": F.length, "head": lambda c: F.get(c, F.lit(0)),
            "last": lambda c: F.try_element_at(c, F.lit(-1)), "tostring": lambda c: c.cast("string"), "tointeger": lambda c: c.try_cast("long"), "tofloat": lambda c: c.try_cast("double"), "reverse": F.reverse,
        }
        if name in simple and len(args) == 1:
            return simple[name](args[0])
        if name == "coalesce":
            return F.coalesce(*args)
        if name == "replace" and len(args) == 3:
            return F.replace(*args)
        raise QueryError(f"unknown function {name}")

    def _counted(self, x: S.Node, local: dict) -> Column:
        return self._expr(x, local)

    def _about(self, name: str, arg: S.Node) -> Column:
        if not isinstance(arg, S.Variable) or arg.name not in self.scope:
            raise QueryError(f"{name} needs a variable")
        binding = self.scope[arg.name]
        if name in ("id", "elementid"):
            return F.col(f"`{arg.name}$id`")
        if name == "labels":
            column = f"{arg.name}$label"
            return F.array(F.col(f"`{column}`") if column in self.frame.columns else F.lit(binding.labels[0]))
        if name == "type":
            return F.col(f"`{arg.name}$type`")
        own = [c for c in self._columns_of(arg.name) if c.split("$", 1)[1] not in ("id", "label", "type", "a", "b", "la", "lb")]
        return F.struct(*[F.col(f"`{c}`").alias(c.split("$", 1)[1]) for c in own])


def _counts(p: S.Projection) -> bool:
    """Whether all that a projection makes of its rows are counts and what doesn't depend on repeated rows."""
    calls = [x for i in p.items for x in i.expr.walk() if isinstance(x, S.Call) and x.name in S.AGGREGATES]
    return bool(calls) and all(x.distinct or x.name in ("count", "min", "max") for x in calls)


def _direction(c: Column, descending: bool) -> Column:
    return c.desc_nulls_first() if descending else c.asc_nulls_last()


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def answer(graph: Graph, text: str, params: dict | None = None, *, cap: int | None = None) -> DataFrame:
    """The result of a query text; with ``cap``, no more rows than that (a smaller final LIMIT stays)."""
    query = S.parse(text)
    result = Lowering(graph, params).run(query)
    return result.limit(cap) if cap is not None and (query.result.limit is None or query.result.limit > cap) else result
