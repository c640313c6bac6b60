"""WARC archives of captured pages, and their index by external merge.

Tasks write archives (a gzip member a record) and, beside each, its captures in the order
of URL key, time, page: a sorted run, a file of small blocks. Of the runs only the first
and last keys of the blocks travel: the sparse index. Up to FAN_IN runs are merged at a
time. Their order is cut at common borders, and a task streams the blocks of one range
from all runs into a loser tree, one block a run in memory. As long as there are more
runs, each group's merge is written as a longer run; the last merge is the index, where
the captures of a URL stand together, oldest first.

Of records with equal payloads (by SHA-1) the one with the smallest page id holds the
payload, the others are revisits that name it. Which pages those are is settled on
digests before any payload moves.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import io
import itertools
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Files, raw, small, spread, table, written

#: Compressed bytes after which a task starts another archive.
ARCHIVE_BYTES = 64 << 20
#: Captures without a time of their own are dated one second a page id from here on.
EPOCH = 1_700_000_000
#: Runs that are merged at a time, captures of a block, and captures that a task merges (a range of the order).
FAN_IN, BLOCK, PART = 128, 512, 250_000
#: Keys of blocks that the driver draws the borders from, at most about.
BORDER_KEYS = 100_000
_CHUNK = 1 << 16
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_UNSAFE = re.compile(rb"[\x00-\x20\x7f]")


def url_key(url: str | None) -> str:
    """The URL's sort key: host names reversed and joined by commas, then ')' and the path, in lower case; no scheme, user, port or leading www. A missing URL has the empty key."""
    if not url:
        return ""
    rest = re.sub(r"^[a-z][a-z0-9+.-]*://", "", url.strip().lower())
    host, slash, path = re.match(r"([^/?#]*)(/?)(.*)", rest, re.DOTALL).groups()
    host = re.sub(r":\d*$", "", host.rpartition("@")[2])
    host = re.sub(r"^www\d*\.", "", host)
    return ",".join(reversed(host.split("."))) + ")/" + re.sub(r"#.*$", "", path, flags=re.DOTALL)


def digest_text(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record(kind: str, page: int | None, url: str | None, when: int, sha1: bytes, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record; a revisit has the HTTP head only, whose length is that of the full payload."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if kind == "revisit" else head + payload
    lines = [b"WARC/1.1", b"WARC-Type: " + kind.encode(), b"WARC-Record-ID: <urn:page:%s>" % _name(page), b"WARC-Date: " + _date(when)]
    if url is not None:
        lines.append(b"WARC-Target-URI: " + _UNSAFE.sub(lambda m: b"%%%02X" % m[0][0], url.encode()))
    lines.append(b"WARC-Payload-Digest: sha1:" + base64.b32encode(sha1))
    if kind == "revisit":
        lines += [b"WARC-Refers-To: <urn:page:%s>" % _name(refers_to), b"WARC-Profile: " + PROFILE]
    lines += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def _name(page: int | None) -> bytes:
    return b"unknown" if page is None else b"%d" % page


def _date(seconds: int) -> bytes:
    days, rest = divmod(seconds, 86_400)
    z = days + 719_468  # days from 0000-03-01, the era's arithmetic of the proleptic Gregorian calendar
    era, doe = divmod(z, 146_097)
    yoe = (doe - doe // 1460 + doe // 36_524 - doe // 146_096) // 365
    doy = doe - (365 * yoe + yoe // 4 - yoe // 100)
    mp = (5 * doy + 2) // 153
    month = mp + 3 if mp < 10 else mp - 9
    return b"%04d-%02d-%02dT%02d:%02d:%02dZ" % (yoe + era * 400 + (month <= 2), month, doy - (153 * mp + 2) // 5 + 1, rest // 3600, rest // 60 % 60, rest % 60)


def records_of(archive: bytes | BinaryIO) -> Iterator[tuple[int, dict[str, bytes], bytes]]:
    """Offset, header fields (names in lower case) and block of each record of an archive, which is read as the records are asked for."""
    source = io.BytesIO(archive) if isinstance(archive, bytes) else archive
    at, ahead = 0, source.read(_CHUNK)
    while ahead:
        member, parts, taken = zlib.decompressobj(wbits=31), [], 0
        while ahead and not member.eof:
            parts.append(member.decompress(ahead))
            taken += len(ahead)
            ahead = member.unused_data if member.eof else source.read(_CHUNK)
        if not member.eof:
            raise ValueError("an archive ends within a record")
        head, _, rest = b"".join(parts).partition(b"\r\n\r\n")
        version, *lines = head.split(b"\r\n")
        if not version.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        fields = {k.decode().lower(): v.strip() for k, _, v in (x.partition(b":") for x in lines)}
        yield at, fields, rest[: int(fields["content-length"])]
        at += taken - len(ahead)
        ahead = ahead or source.read(_CHUNK)


class LoserTree:
    """Merges k sorted runs: each inner node keeps the loser of its match, so the next winner costs one match a level."""

    def __init__(self, runs: list[Iterable]):
        self.runs = [iter(r) for r in runs]
        self.head = [next(r, None) for r in self.runs]
        self.size = max(1, len(runs))
        self.loser = [-1] * self.size
        for k in range(len(runs)):
            self._play(k)

    def _beats(self, a: int, b: int) -> bool:
        """Does run a's head come before run b's? An ended run loses, of equals the earlier run wins."""
        x, y = self.head[a], self.head[b]
        return y is None or x is not None and (x, a) < (y, b)

    def _play(self, run: int) -> None:
        node = (run + self.size) // 2
        while node > 0:
            other = self.loser[node]
            if other < 0:  # while the tree is filled, the first to come waits here
                self.loser[node] = run
                return
            if self._beats(other, run):
                self.loser[node], run = run, other
            node //= 2
        self.loser[0] = run

    def __iter__(self) -> Iterator:
        while self.runs and self.head[self.loser[0]] is not None:
            winner = self.loser[0]
            yield self.head[winner]
            self.head[winner] = next(self.runs[winner], None)
            self._play(winner)


_CAPTURES = pa.schema([("url_key", pa.string()), ("time", pa.int64()), ("page_id", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
_CAPTURES_SQL = "url_key string, time long, page_id long, archive string, offset long, length long"
_BLOCKS = pa.schema([("archive", pa.string()), ("run", pa.string()), ("seq", pa.int64()), ("file", pa.string()), ("block", pa.int32()), ("n", pa.int32()), ("low", pa.binary()), ("high", pa.binary())])
_BLOCKS_SQL = "archive string, run string, seq long, file string, block int, n int, low binary, high binary"
_RUN = pa.schema([("key", pa.binary()), *_CAPTURES])


def sort_key(url_key: str, time: int, page: int | None, archive: str, offset: int) -> bytes:
    """Bytes in the order of the fields, one after the other. A null page counts as -1; no two captures share archive and offset."""
    number = struct.pack(">QQ", time + (1 << 63), (-1 if page is None else page) + (1 << 63))
    return url_key.encode().replace(b"\0", b"\0\xff") + b"\0" + number + archive.encode() + b"\0" + struct.pack(">Q", offset)


def _write_run(files: Files, run: str, seq: int, archive: str | None, captures: Iterable[tuple], block: int) -> Iterator[pa.RecordBatch]:
    """Write captures, (key, fields) in order, as a file of blocks; its rows of the sparse index."""
    index: list[tuple] = []

    def chunks() -> Iterator[bytes]:
        out = io.BytesIO()
        source = iter(captures)
        with pa.ipc.new_file(out, _RUN) as writer:
            while rows := list(itertools.islice(source, block)):
                writer.write_batch(table(_RUN, *map(list, zip(*rows, strict=True))))
                index.append((len(rows), rows[0][0], rows[-1][0]))
                yield out.getvalue()[: out.tell()]
                out.seek(0)
                out.truncate()
        yield out.getvalue()

    name = files.write(".run", chunks())
    for k in range(0, len(index), 10_000):
        some = index[k : k + 10_000]
        same = lambda x: [x] * len(some)  # noqa: E731, B023
        yield table(_BLOCKS, same(archive), same(run), same(seq), same(name), list(range(k, k + len(some))), *map(list, zip(*some, strict=True)))


def _read_run(files: Files, blocks: list[tuple[str, int]], low: bytes | None, high: bytes | None) -> Iterator[tuple]:
    """The captures of a run's blocks (file, number) from key ``low`` to before ``high``; one block is in memory."""
    for name, own in itertools.groupby(blocks, key=lambda b: b[0]):
        with files.open(name) as source:
            reader = pa.ipc.open_file(source)
            for _, block in own:
                batch = reader.get_batch(block)
                keys = batch.column(0).to_pylist()
                first = bisect.bisect_left(keys, low) if low is not None else 0
                last = bisect.bisect_left(keys, high) if high is not None else len(keys)
                yield from zip(*(c.to_pylist() for c in batch.slice(first, last - first).columns), strict=True)


def _sha1(payload: str) -> Column:
    return F.sha1(F.coalesce(F.col(payload), F.lit("")).cast("binary"))


def write_archives(pages: DataFrame, files: Files, key: str = "page_id", url: str = "url", payload: str = "html", time: Column | None = None, least_payload: int = 0, archive_bytes: int = ARCHIVE_BYTES, block: int = BLOCK) -> DataFrame:
    """Write a record for each row, and each archive's captures as a sorted run; returns the sparse index of the runs, a row a block.

    A null payload is empty, a null URL gives no target, a null page id counts as larger
    than all others and is never referred to. Rows that share the smallest id of a
    payload are all responses. Payloads under ``least_payload`` bytes are never revisits.
    """
    when = F.lit(EPOCH) + F.col("page") if time is None else time.cast("long")
    rows = pages.select(F.col(key).cast("long").alias("page"), F.col(url).alias("url"), F.col(payload).alias("payload")) if time is None else pages.select(F.col(key).cast("long").alias("page"), F.col(url).alias("url"), F.col(payload).alias("payload"), when.alias("at"))
    digests = rows.select("page", _sha1("payload").alias("sha1"), F.coalesce(F.octet_length("payload"), F.lit(0)).alias("bytes")).where(F.col("bytes") >= least_payload)
    first = digests.groupBy("sha1").agg(F.min("page").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 AND first IS NOT NULL").select("sha1", "first")
    # Of a payload without copies nothing is carried on; the list of copies is small next to the payloads.
    copies = written(first, "copies")
    joined = rows.withColumn("sha1", _sha1("payload")).join(small(copies, 60), "sha1", "left")
    enough = F.coalesce(F.octet_length("payload"), F.lit(0)) >= least_payload
    refers = F.when(enough & F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page")), F.col("first"))
    ready = joined.select("page", "url", "payload", refers.alias("refers_to"), F.coalesce(when if time is None else F.col("at"), F.lit(EPOCH)).alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = _rows(batches)
        pending = next(source, None)
        while pending is not None:
            captures: list[list] = []

            def chunks() -> Iterator[bytes]:
                nonlocal pending
                offset = 0
                while pending is not None and (offset < archive_bytes or not captures):
                    page, link, body, refers_to, at = pending
                    data = record("response" if refers_to is None else "revisit", page, link, at, hashlib.sha1(body).digest(), body, refers_to)
                    packer = zlib.compressobj(level=4, wbits=31)
                    data = packer.compress(data) + packer.flush()
                    captures.append([url_key(link), at, page, "", offset, len(data)])
                    offset += len(data)
                    yield data
                    pending = next(source, None)

            name = files.write(".warc.gz", chunks())
            for c in captures:
                c[3] = name
            yield from _write_run(files, name, 0, name, sorted((sort_key(*c[:5]), *c) for c in captures), block)

    return written(ready.mapInArrow(run, _BLOCKS_SQL), "runs")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for k in range(0, batch.num_rows, 200):
            part = batch.slice(k, 200)
            yield from zip(part.column(0).to_pylist(), part.column(1).to_pylist(), raw(part.column(2)), part.column(3).to_pylist(), part.column(4).to_pylist(), strict=True)


def _borders(blocks: DataFrame, parts: int) -> list[bytes]:
    """Keys that cut the order into ``parts`` ranges of about equally many blocks, from a bounded sample of the blocks."""
    total = blocks.count()
    some = blocks if total <= BORDER_KEYS else blocks.where(F.pmod(F.xxhash64("low"), F.lit(total)) < BORDER_KEYS)
    keys = sorted(bytes(r.low) for r in some.select("low").collect())
    return sorted({keys[len(keys) * k // parts] for k in range(1, parts)}) if keys else []


def _dealt(blocks: DataFrame, groups: int, borders: list[bytes]) -> DataFrame:
    """Each block with the group of its run and every range that it reaches into, a task a group and range, in order."""
    shared = blocks.sparkSession.sparkContext.broadcast(borders)
    schema = pa.schema([("grp", pa.int64()), ("part", pa.int64()), *_BLOCKS])

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, high = ([bisect.bisect_right(shared.value, k) for k in batch.column(c).to_pylist()] for c in (7, 8))
            rows = [(i, part) for i, (a, b) in enumerate(zip(low, high, strict=True)) for part in range(a, b + 1)]
            own = batch.take(pa.array([i for i, _ in rows], type=pa.int64()))
            yield table(schema, own.column(0), [p for _, p in rows], *own.columns[1:])

    marked = blocks.select(F.pmod(F.xxhash64("run"), F.lit(groups)).alias("grp"), *_BLOCKS.names).mapInArrow(ranges, f"grp long, part long, {_BLOCKS_SQL}")
    return marked.repartition(groups * (len(borders) + 1), "grp", "part").sortWithinPartitions("grp", "part", "run", "seq", "block")


def _merged(batches: Iterator[pa.RecordBatch], files: Files, borders: list[bytes]) -> Iterator[tuple[int, int, Iterator[tuple]]]:
    """(group, range, its captures in order) of each group and range at hand, by a loser tree over its runs."""
    rows = (r for batch in batches for r in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3, 5, 6)), strict=True))
    for (group, part), own in itertools.groupby(rows, key=lambda r: r[:2]):
        runs = [[(file, block) for *_, file, block in r] for _, r in itertools.groupby(own, key=lambda r: r[2])]
        low, high = borders[part - 1] if part else None, borders[part] if part < len(borders) else None
        yield group, part, iter(LoserTree([_read_run(files, r, low, high) for r in runs]))


def merge_index(runs: DataFrame, files: Files, fan_in: int = FAN_IN, part: int = PART, block: int = BLOCK) -> DataFrame:
    """The captures of all runs in the order of URL key, time and page: columns of a capture, index_part and index_pos.

    Each part is one range of that order, so a URL with very many captures spreads over
    parts; (index_part, index_pos) is the global order. A null page counts as -1.
    """
    level = 0
    while True:
        count = runs.select("run").distinct().count()
        groups = -(-count // fan_in) if count > fan_in else 1
        total = runs.agg(F.sum("n")).first()[0] or 0
        # Ranges enough to keep the cores busy, and none of more than about ``part`` captures.
        parts = max(1, -(-total // (groups * part)), min(2 * runs.sparkSession.sparkContext.defaultParallelism // groups, total // (4 * block)))
        borders = _borders(runs, parts)
        dealt = _dealt(runs, groups, borders)
        if count <= fan_in:
            break
        level += 1

        def lengthen(batches: Iterator[pa.RecordBatch], level: int = level, borders: list[bytes] = borders) -> Iterator[pa.RecordBatch]:
            for group, place, captures in _merged(batches, files, borders):
                yield from _write_run(files, f"{level}-{group}", place, None, captures, block)

        runs = written(dealt.mapInArrow(lengthen, _BLOCKS_SQL), "runs")

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([*_CAPTURES, ("index_part", pa.int32()), ("index_pos", pa.int64())])
        for _, place, captures in _merged(batches, files, borders):
            at = 0
            while block := list(itertools.islice(captures, 10_000)):
                yield table(schema, *map(list, zip(*(c[1:] for c in block), strict=True)), [place] * len(block), list(range(at, at + len(block))))
                at += len(block)

    return dealt.mapInArrow(last, _CAPTURES_SQL + ", index_part int, index_pos long")


def read_archives(runs: DataFrame, files: Files) -> DataFrame:
    """Every record of the archives that the runs name: archive, offset, page_id, url, payload_bytes, payload_digest, record_type, refers_to.

    A response's digest is computed from its payload and held against its header; a
    revisit's, and its length, come from its headers.
    """
    schema = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def page(reference: bytes | None) -> int | None:
        name = (reference or b"").removeprefix(b"<urn:page:").removesuffix(b">")
        return int(name) if name not in (b"", b"unknown") else None

    def one(name: str, at: int, fields: dict[str, bytes], block: bytes) -> tuple:
        http, _, payload = block.partition(b"\r\n\r\n")
        digest, kind = fields["warc-payload-digest"].decode().removeprefix("sha1:"), fields["warc-type"].decode()
        size = int(re.search(rb"Content-Length: (\d+)", http)[1])
        if kind == "response" and (len(payload) != size or digest_text(hashlib.sha1(payload).digest()) != digest):
            raise ValueError(f"the record at {at} of {name} is damaged")
        link = fields.get("warc-target-uri")
        return name, at, page(fields["warc-record-id"]), None if link is None else link.decode(), size, digest, kind, page(fields.get("warc-refers-to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with files.open(name) as source:
                    records = (one(name, *x) for x in records_of(source))
                    while rows := list(itertools.islice(records, 2000)):
                        yield table(schema, *map(list, zip(*rows, strict=True)))

    names = written(runs.where("block = 0").select("archive"), "archives")
    return spread(names).mapInArrow(run, "archive string, offset long, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def ranked(index: DataFrame) -> DataFrame:
    """The index with index_rank, the place of each capture in the global order, from 0. One number a part reaches the driver."""
    index = written(index, "index")
    sizes = {r["index_part"]: r["count"] for r in index.groupBy("index_part").count().collect()}
    before, total = [], 0
    for part in sorted(sizes):
        before.append((part, total))
        total += sizes[part]
    starts = index.sparkSession.createDataFrame(before, "index_part int, before long")
    return index.join(F.broadcast(starts), "index_part").withColumn("index_rank", F.col("before") + F.col("index_pos")).drop("before")


def oracle() -> str:
    """DuckDB SQL for the query's columns over the table ``pages``: base32 takes five bits at a time from the hexadecimal digest."""
    return f"""
    WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, regexp_replace(lower(trim(coalesce(url, ''))), '^[a-z][a-z0-9+.-]*://', '') AS rest FROM pages),
    q AS (SELECT page_id, url, octet_length(encode(html)) AS payload_bytes, sha1(html) AS h, regexp_extract(rest, '^([^/?#]*)(/?)((?s:.*))$', 1) AS host, regexp_extract(rest, '^([^/?#]*)(/?)((?s:.*))$', 3) AS path FROM p),
    r AS (SELECT page_id, payload_bytes, h, min(page_id) OVER (PARTITION BY h) AS first,
        CASE WHEN coalesce(url, '') = '' THEN '' ELSE array_to_string(list_reverse(string_split(regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '^www[0-9]*[.]', ''), '.')), ',') || ')/' || regexp_replace(path, '#(?s:.*)$', '') END AS url_key FROM q)
    SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
        array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, ((5 * i) // 4 + 1)::INT, 2))::INT >> (3 - (5 * i) % 4)::INT) & 31) + 1, 1)), '') AS payload_digest,
        CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to,
        (row_number() OVER (ORDER BY url_key, {EPOCH} + page_id, page_id) - 1)::BIGINT AS index_rank FROM r"""
