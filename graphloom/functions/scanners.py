"""What column expressions can't say: a scanner of SQL statements and a splitter by bytes. Both run on batches."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"--[^\n]*|/\*.*?\*/|'(?:[^']|'')*'|[\w$#.\"`\[\]]+|[(),;=]|:\w+|\?", re.DOTALL)
# Words that are never tables, and what starts a clause of tables.
_WORDS = {"SELECT", "FROM", "WHERE", "SET", "VALUES", "ON", "USING", "JOIN", "INNER", "LEFT", "RIGHT", "FULL", "CROSS", "OUTER", "NATURAL", "GROUP", "ORDER", "HAVING", "LIMIT", "UNION", "ALL", "AS", "INTO", "UPDATE", "DELETE", "INSERT", "MERGE", "WHEN", "THEN", "ONLY", "LATERAL", "DUAL", "WITH", "EXISTS", "IN", "AND", "OR", "NOT"}


def sql_tables(sql: str | None) -> list[tuple[str, str]]:
    """Distinct (table, Read or Write) in the order of the statement; schemas are stripped, names in upper case, common table expressions aren't tables."""
    tokens = [t for t in _TOKEN.findall(sql or "") if not t.startswith(("--", "/*", "'"))]
    words = [t.upper().strip('"`[]') for t in tokens]
    local = {words[i - 1] for i in range(1, len(words) - 1) if words[i] == "AS" and words[i + 1] == "("}
    found: dict[tuple[str, str], None] = {}
    i, depth, lists = 0, 0, []

    def table(at: int, mode: str) -> None:
        if at < len(words) and re.match(r"[A-Z_][\w$#.\"`\[\]]*$", words[at]) and words[at] not in _WORDS:
            name = re.sub(r"[\"`\[\]]", "", words[at]).rpartition(".")[2]
            if name and name not in local and not (at + 1 < len(words) and words[at + 1] == "(" and mode == "Read"):
                found[name, mode] = None

    while i < len(words):
        w = words[i]
        if w == "(":
            depth += 1
        elif w == ")":
            depth -= 1
            lists = [d for d in lists if d <= depth]
        elif w in ("FROM", "JOIN", "USING"):
            if not (w == "FROM" and i and words[i - 1] == "DELETE"):
                table(i + 1, "Read")
            else:
                table(i + 1, "Write")
            if w == "FROM":
                lists.append(depth)
        elif w == "," and depth in lists:
            table(i + 1, "Read")
        elif w in ("WHERE", "SET", "GROUP", "ORDER", "SELECT", "ON", "VALUES", "HAVING") and depth in lists and w != "ON":
            lists.remove(depth)
        elif w == "INTO":
            table(i + 1, "Write")
        elif w == "UPDATE" and not (i and words[i - 1] in ("FOR", "THEN")):
            table(i + 1, "Write")
        i += 1
    return list(found)


def chunks(text: str | None, size: int = 4000, overlap: int = 500) -> list[tuple[int, int, int, str]]:
    """Windows of at most ``size`` bytes with an overlap, cut between characters: first byte, first line, last line, text."""
    if overlap >= size:
        raise ValueError("the overlap must be smaller than the window")
    data, out, at = (text or "").encode(), [], 0
    while at < len(data):
        end = min(len(data), at + size)
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        piece = data[at:end]
        first = data.count(b"\n", 0, at) + 1
        out.append((at, first, first + piece.count(b"\n"), piece.decode()))
        if end == len(data):
            break
        at = max(end - overlap, at + 1)
        while data[at] & 0xC0 == 0x80:
            at += 1
    return out


def tables_of(sql: Column) -> Column:
    """Array of (table, mode) of SQL texts."""

    @F.pandas_udf("array<struct<table:string,mode:string>>")
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(lambda s: [{"table": t, "mode": m} for t, m in sql_tables(s)])

    return run(sql)


def chunks_of(text: Column, size: int = 4000, overlap: int = 500) -> Column:
    @F.pandas_udf("array<struct<first_byte:long,first_line:long,last_line:long,text:string>>")
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(lambda s: [dict(zip(("first_byte", "first_line", "last_line", "text"), c, strict=True)) for c in chunks(s, size, overlap)])

    return run(text)
