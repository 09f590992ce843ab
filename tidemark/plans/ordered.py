"""A SELECT whose rows come in one defined order.

Spark promises no order without ORDER BY, and none among ties. Here every
table reference carries its rows' places in their files, and these break
ties: rows without ORDER BY come as a nested loop over the FROM list would
make them. This costs a sort, so it is an option and not the default.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.relational import sort_key
from tidemark.plans.script import lexemes, split_at
from tidemark.sources.text import POSITION

#: Suffix of the views that have POSITION as well.
PLACED = "__placed"

_CLAUSES = ("SELECT", "FROM", "WHERE", "ORDER BY")


@dataclass
class Select:
    items: list[str]
    tables: list[tuple[str, str]]
    where: str | None = None
    order: list[str] = field(default_factory=list)
    distinct: bool = False


def _clauses(text: str) -> dict[str, str]:
    flat = "".join(x if depth <= 0 and x[0] not in "'\"`" else "\0" * len(x) for x, depth in lexemes(text))
    plain = "".join(x for x, _ in lexemes(text))
    found = [(m.start(), m.end(), re.sub(r"\s+", " ", m[0].upper())) for m in re.finditer(r"\b(SELECT|FROM|WHERE|ORDER\s+BY)\b", flat, re.IGNORECASE)]
    names = [name for *_, name in found]
    if names[:2] != ["SELECT", "FROM"] or names != [c for c in _CLAUSES if c in names] or flat[: found[0][0]].strip():
        raise ValueError(f"not of the form SELECT FROM [WHERE] [ORDER BY]: {text}")
    if m := re.search(r"\b(GROUP\s+BY|HAVING|LIMIT|OFFSET|UNION|INTERSECT|EXCEPT|JOIN|WINDOW)\b", flat, re.IGNORECASE):
        raise ValueError(f"{m[0]} has no defined row order here; run it as plain SQL: {text}")
    ends = [start for start, *_ in found[1:]] + [len(plain)]
    return {name: plain[stop:end].strip() for (_, stop, name), end in zip(found, ends, strict=True)}


def parse_select(text: str) -> Select:
    """Take a comma-FROM SELECT apart. Expressions stay text, for Spark to parse."""
    parts = _clauses(text.strip().rstrip(";"))
    head = parts["SELECT"]
    distinct = re.match(r"DISTINCT\s+", head, re.IGNORECASE)
    tables = []
    for item in split_at(parts["FROM"], ","):
        words = item.split()
        if len(words) == 3 and words[1].upper() == "AS":
            del words[1]
        if len(words) not in (1, 2):
            raise ValueError(f"not a table with at most an alias: {item}")
        tables.append((words[0], words[-1]))
    return Select(
        items=split_at(head[distinct.end() :] if distinct else head, ","),
        tables=tables,
        where=parts.get("WHERE"),
        order=split_at(parts["ORDER BY"], ",") if "ORDER BY" in parts else [],
        distinct=bool(distinct),
    )


def _item(text: str) -> tuple[Column, str]:
    """An item's expression and its name."""
    m = re.fullmatch(r"(.+?)(?:\s+AS\s+|\s+)(\w+)", text, re.IGNORECASE | re.DOTALL)
    if m and m[1].strip()[-1] not in "+-*/%<>=,":
        return F.expr(m[1]), m[2]
    return F.expr(text), re.sub(r"^\w+\.(?=\w+$)", "", text)


def ordered_select(spark: SparkSession, statement: str | Select) -> DataFrame:
    """Run a SELECT over tables registered with positions.

    Without ORDER BY rows come in the order of the positions, first table
    first; with it, positions break ties. DISTINCT alone orders by all
    output columns; with ORDER BY by the keys, then by the first place that
    each row is made at.
    """
    s = parse_select(statement) if isinstance(statement, str) else statement
    inputs = [spark.table(name + PLACED).alias(alias) for name, alias in s.tables]
    rows = inputs[0]
    for right in inputs[1:]:
        rows = rows.crossJoin(right)
    if s.where:
        rows = rows.filter(F.expr(s.where))
    outputs: list[tuple[Column, str]] = []
    for item in s.items:
        whole = re.fullmatch(r"(?:(\w+)\.)?\*", item)
        if not whole:
            outputs.append(_item(item))
            continue
        for (_, alias), df in zip(s.tables, inputs, strict=True):
            if whole[1] is None or whole[1].lower() == alias.lower():
                outputs += [(F.col(f"{alias}.{c}"), c) for c in df.columns if c != POSITION]
    place = F.struct(*(F.col(f"{alias}.{POSITION}").alias(f"p{i}") for i, (_, alias) in enumerate(s.tables)))
    keys = [sort_key(k) for k in s.order]
    named = [c.alias(f"c{i}") for i, (c, _) in enumerate(outputs)]
    cells = [f"c{i}" for i in range(len(outputs))]
    if s.distinct and keys:
        _check_projected(s, outputs)
        sought = [f"k{i}" for i in range(len(keys))]
        made = rows.select(*named, place.alias(POSITION), *(F.expr(k).alias(c) for c, k in zip(sought, _bare(s.order), strict=True)))
        groups = made.groupBy(*cells, *sought).agg(F.min(POSITION).alias(POSITION))
        order = [F.col(c).desc() if k.upper().endswith(" DESC") else F.col(c).asc() for c, k in zip(sought, s.order, strict=True)]
        out = groups.orderBy(*order, POSITION).select(*cells)
    elif s.distinct:
        out = rows.select(*named).distinct().orderBy(*cells)
    else:
        out = rows.orderBy(*keys, place).select(*named)
    return out.toDF(*(name for _, name in outputs))


def _bare(keys: list[str]) -> list[str]:
    return [re.sub(r"\s+(ASC|DESC)$", "", k.strip(), flags=re.IGNORECASE) for k in keys]


def _check_projected(s: Select, outputs: list[tuple[Column, str]]) -> None:
    """With DISTINCT a key must be an output, else the order of a group is not defined."""
    names = {name.lower() for _, name in outputs}
    for key in _bare(s.order):
        if key.rpartition(".")[2].lower() not in names:
            raise ValueError(f"ORDER BY {key} is not in the list of SELECT DISTINCT")
