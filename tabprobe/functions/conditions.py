"""Filter conditions as data: ``(column, op, value)`` or one ``"column op literal"`` text.

One regular expression splits the text; the column must exist and the literal is
bound with ``F.lit``. Text is never handed to ``F.expr``, which could reach
functions such as ``reflect`` that run JVM code.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabprobe.functions.exprs import col

OPS = ("=", "==", "!=", "<>", "<", "<=", ">", ">=", "in", "not in", "is null", "is not null")

_TEXT = re.compile(
    r"^\s*(?:`(?P<q>[^`]+)`|(?P<c>[^\s<>=!]+))\s*"
    r"(?P<op><=|>=|==|!=|<>|=|<|>|not\s+in\b|in\b|is\s+not\s+null\b|is\s+null\b)\s*(?P<v>.*?)\s*$",
    re.IGNORECASE,
)


def _literal(text: str):
    t = text.strip()
    if len(t) >= 2 and t[0] == t[-1] and t[0] in "'\"":
        return t[1:-1]
    low = t.lower()
    if low in ("true", "false"):
        return low == "true"
    if low == "null":
        return None
    if re.fullmatch(r"[+-]?[0-9]+", t):
        return int(t)
    if re.fullmatch(r"[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?", t):
        return float(t)
    if re.search(r"\s", t):
        raise ValueError(f"unquoted text with spaces: {t!r}; quote the literal, or join conditions with AND")
    return t


def split_conditions(text: str) -> list[str]:
    """The conditions that AND joins outside quotes and parentheses."""
    parts, start, depth, quote = [], 0, 0, ""
    for m in re.finditer(r"['\"`()]|\band\b", text, re.IGNORECASE):
        t = m.group()
        if quote:
            quote = "" if t == quote else quote
        elif t in "'\"`":
            quote = t
        elif t in "()":
            depth += 1 if t == "(" else -1
        elif depth == 0:
            parts.append(text[start:m.start()])
            start = m.end()
    return [p.strip() for p in [*parts, text[start:]]]


def parse_condition(text: str) -> tuple[str, str, object]:
    m = _TEXT.match(text)
    if not m:
        raise ValueError(f"cannot read condition {text!r}; expected 'column op literal' with op in {OPS}")
    name = m.group("q") or m.group("c")
    op = " ".join(m.group("op").lower().split())
    raw = m.group("v")
    if op in ("in", "not in"):
        inner = raw.strip()
        if inner.startswith("(") and inner.endswith(")"):
            inner = inner[1:-1]
        value = [_literal(p) for p in re.findall(r"'[^']*'|\"[^\"]*\"|[^,]+", inner) if p.strip()]
    elif op in ("is null", "is not null"):
        if raw:
            raise ValueError(f"unexpected text after {op!r} in {text!r}")
        value = None
    else:
        value = _literal(raw)
    return name, op, value


def condition_column(cond, columns: list[str]) -> Column:
    """Build the predicate; the column must be one of ``columns``."""
    name, op, value = parse_condition(cond) if isinstance(cond, str) else cond
    op = op.lower()
    if name not in columns:
        raise ValueError(f"unknown column {name!r} in condition")
    c = col(name)
    if op in ("=", "=="):
        return c == F.lit(value)
    if op in ("!=", "<>"):
        return c != F.lit(value)
    if op == "<":
        return c < F.lit(value)
    if op == "<=":
        return c <= F.lit(value)
    if op == ">":
        return c > F.lit(value)
    if op == ">=":
        return c >= F.lit(value)
    if op == "in":
        return c.isin(list(value))
    if op == "not in":
        return ~c.isin(list(value))
    if op == "is null":
        return c.isNull()
    if op == "is not null":
        return c.isNotNull()
    raise ValueError(f"unknown operator {op!r}; expected one of {OPS}")
