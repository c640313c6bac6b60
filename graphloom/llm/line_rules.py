"""Quality rules, lines first: lines that fail a rule go, then documents that lost too much of their text.

Rules of a line, on its words (a line without a word is dropped and counts for nothing):

* boilerplate: it holds one of a list of phrases, in any case;
* navigation: two separators of menus or more;
* punctuation: fewer than ``short_line`` words and no closing mark at its end;
* symbols: symbols number over ``symbol_share`` of its words;
* capitals: over half of its ASCII letters are capitals, of 10 letters or more;
* repeated: it equals an earlier line of the text.

A text is kept if it passes the base rules and the failed lines hold at most
``lost_share`` of the characters in its words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import keyed, steps, table

# Phrases of boilerplate lines, menu separators, closing marks, symbols.
BOILERPLATE = (
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "use cookies", "accept cookies",
    "enable javascript", "subscribe to our newsletter", "sign up", "log in", "click here", "read more", "share this", "back to top",
    "skip to content", "powered by", "copyright (c)", "lorem ipsum", "licensed under", "spdx-license-identifier",
)
SEPARATORS = "|»›·•"
CLOSING = ".!?:;…\"'”’)»"
SYMBOLS = "#*$%&|<>"

WINDOW = 8


@dataclass(frozen=True)
class LineRules:
    short_line: int = 8
    symbol_share: float = 0.25
    lost_share: float = 0.30
    min_words: int = 20
    repeat_share: float = 0.30


_BOILERPLATE = re.compile("|".join(re.escape(x) for x in BOILERPLATE).encode(), re.IGNORECASE)
_SEPARATOR = re.compile(f"[{SEPARATORS}]")
_SYMBOL = re.compile(f"[{re.escape(SYMBOLS)}]".encode())


def line_fault(line: bytes, words: list[bytes], rules: LineRules) -> str:
    """The first rule that a line with words fails, or the empty string."""
    if _BOILERPLATE.search(line):
        return "boilerplate"
    if (b"|" in line or not line.isascii()) and len(_SEPARATOR.findall(line.decode())) >= 2:
        return "navigation"
    if len(words) < rules.short_line and words[-1].decode()[-1] not in CLOSING:
        return "punctuation"
    if len(_SYMBOL.findall(line)) > rules.symbol_share * len(words):
        return "symbols"
    capitals = len(line) - len(line.translate(None, _CAPITALS))
    letters = len(line) - len(line.translate(None, _LETTERS))
    return "capitals" if letters >= 10 and 2 * capitals > letters else ""


_CAPITALS = bytes(range(65, 91))
_LETTERS = _CAPITALS + bytes(range(97, 123))


def repeated_words(docs: list[list[bytes]]) -> np.ndarray:
    """For each text, how many of its words lie in an 8-word window that the text has twice or more."""
    sizes = np.array([len(w) for w in docs], dtype=np.int64)
    total = int(sizes.sum())
    if total < WINDOW:
        return np.zeros(len(docs), dtype=np.int64)
    seen = dict.fromkeys(w for words in docs for w in words)
    seen = {w: i for i, w in enumerate(seen)}
    ids = np.fromiter((seen[w] for words in docs for w in words), dtype=np.int64, count=total)
    doc = np.repeat(np.arange(len(docs)), sizes)
    last = total - WINDOW + 1
    starts = np.flatnonzero(doc[:last] == doc[WINDOW - 1 :])
    rng = np.random.default_rng(20_01)
    word_code = rng.integers(0, 1 << 63, size=len(seen), dtype=np.uint64)[ids]
    code = np.zeros(last, dtype=np.uint64)
    for k in range(WINDOW):
        code = code * np.uint64(0x9E3779B97F4A7C15) + word_code[k : k + last]
    code = code[starts] ^ rng.integers(0, 1 << 63, size=len(docs), dtype=np.uint64)[doc[starts]]
    order = np.argsort(code, kind="stable")
    code, at = code[order], starts[order]
    same = code[1:] == code[:-1]
    a, b = at[1:][same], at[:-1][same]
    alike = doc[a] == doc[b]
    for k in range(WINDOW):
        alike &= ids[a + k] == ids[b + k]
    if alike.all():
        twice = np.concatenate((a, b))
    else:  # two windows share a code: compare the windows themselves
        counts: dict[tuple, list[int]] = {}
        for i in starts.tolist():
            counts.setdefault((doc[i], *ids[i : i + WINDOW].tolist()), []).append(i)
        twice = np.array([i for v in counts.values() if len(v) > 1 for i in v], dtype=np.int64)
    edge = np.zeros(total + 1, dtype=np.int64)
    twice = np.unique(twice)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + WINDOW, -1)
    return np.bincount(doc[np.cumsum(edge[:-1]) > 0], minlength=len(docs))


_COLUMNS = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("lost_chars", pa.int64()), ("faults", pa.list_(pa.string())), ("clean_text", pa.string())]


def clean_by_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """Counts, verdict and cleaned text of every whole text; one row out for each row in.

    Null and empty texts have no words: base_failed, not kept, an empty clean_text.
    ``faults`` names the rules that removed lines, sorted, each once. Repeated rows are
    judged alike; columns besides key and text are not read.
    """
    schema = pa.schema([(key, pa.int64()), *_COLUMNS])
    types = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, lost_chars long, faults array<string>, clean_text string"

    def one(data: bytes, words: list[bytes], n_repeat: int) -> tuple:
        lines: list[bytes] = []
        seen: set[bytes] = set()
        faults: set[str] = set()
        repeated = lost = 0
        for line in data.split(b"\n"):
            if not (of_line := line.split()):
                continue
            fault = line_fault(line, of_line, rules)
            if line in seen:
                repeated += 1
                fault = fault or "repeated"
            seen.add(line)
            if fault:
                faults.add(fault)
                lost += len(b"".join(of_line).decode())
            else:
                lines.append(line)
        chars = len(b"".join(words).decode())
        failed = len(words) < rules.min_words or 100 * n_repeat > round(100 * rules.repeat_share) * len(words)
        kept = not failed and 100 * lost <= round(100 * rules.lost_share) * chars
        return len(words), chars, len(_SYMBOL.findall(data)), repeated, n_repeat, failed, kept, lost, sorted(faults), b"\n".join(lines)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in steps(batches, text, 2 << 20):
            words = [x.split() for x in texts]
            rows = [one(*x) for x in zip(texts, words, repeated_words(words).tolist(), strict=True)]
            columns = [list(x) for x in zip(*rows, strict=True)]
            yield table(schema, part.column(0), *columns[:-1], pa.array(columns[-1], type=pa.binary()).cast(pa.string()))

    return keyed(docs, key, text).mapInArrow(run, f"{key} long, {types}")


def oracle(rules: LineRules = LineRules()) -> str:
    """DuckDB SQL for the query's columns over the table ``documents``."""
    quote = lambda s: s.replace("'", "''")
    phrases = quote("|".join(re.sub(r"([().])", r"\\\1", x) for x in BOILERPLATE))
    word = r"[^\x20\x09-\x0D]+"
    lost, repeat = round(100 * rules.lost_share), round(100 * rules.repeat_share)
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{word}') AS w FROM documents),
    c AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
            len(regexp_extract_all(text, '[{SYMBOLS}]')) AS n_symbols FROM d),
    p AS (SELECT doc_id, unnest(range(1, len(w) - {WINDOW - 2})) AS i, w FROM d WHERE len(w) > {WINDOW}),
    win AS (SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS x FROM p),
    twice AS (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS k FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS n FROM win) WHERE n > 1),
    rep AS (SELECT doc_id, count(DISTINCT k) AS n_repeat_words FROM twice GROUP BY doc_id),
    l0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM d),
    l1 AS (SELECT doc_id, line, no, regexp_extract_all(line, '{word}') AS w FROM l0),
    l2 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY no) > 1 AS again, length(array_to_string(w, '')) AS chars FROM l1 WHERE len(w) > 0),
    l3 AS (SELECT *, CASE WHEN regexp_matches(line, '(?i){phrases}') THEN 'boilerplate'
            WHEN len(regexp_extract_all(line, '[{SEPARATORS}]')) >= 2 THEN 'navigation'
            WHEN len(w) < {rules.short_line} AND NOT contains('{quote(CLOSING)}', right(w[-1], 1)) THEN 'punctuation'
            WHEN len(regexp_extract_all(line, '[{SYMBOLS}]')) > {rules.symbol_share} * len(w) THEN 'symbols'
            WHEN length(regexp_replace(line, '[^A-Za-z]', '', 'g')) >= 10 AND 2 * length(regexp_replace(line, '[^A-Z]', '', 'g')) > length(regexp_replace(line, '[^A-Za-z]', '', 'g')) THEN 'capitals'
            WHEN again THEN 'repeated' END AS fault FROM l2),
    l4 AS (SELECT doc_id, count_if(again) AS n_dup_lines, coalesce(sum(chars) FILTER (fault IS NOT NULL), 0) AS lost_chars,
            coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (fault IS NULL), '') AS clean_text FROM l3 GROUP BY doc_id)
    SELECT doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
        (n_words < {rules.min_words} OR 100 * coalesce(n_repeat_words, 0) > {repeat} * n_words) AS base_failed,
        (NOT (n_words < {rules.min_words} OR 100 * coalesce(n_repeat_words, 0) > {repeat} * n_words) AND 100 * coalesce(lost_chars, 0) <= {lost} * word_chars) AS kept,
        coalesce(lost_chars, 0)::BIGINT AS lost_chars, sha256(coalesce(clean_text, '')) AS clean_sha256
    FROM c LEFT JOIN rep USING (doc_id) LEFT JOIN l4 USING (doc_id)"""
