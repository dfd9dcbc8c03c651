r"""WARC archives of pages, and an external merge of their capture indexes.

Writing: every page becomes one WARC record, a response with the page as payload, or a revisit
of the record with the smallest page id that has the same payload.  A record is a text line
whose line end is the record end of the format (``\r\n\r\n``), so Spark's own writer commits
the archives; they are whole gzip files with one record after the other.

Reading: archives are read as files and parsed record by record; payload digests are computed
anew from the payloads and compared with the headers.

Index: the captures of one archive are sorted by URL key, time and page id: a local run.  A run
is cut at common split keys; all pieces of a key range meet in one task, where a loser tree
merges them.  The ranges in order, and the positions within, are the global capture history.
Split keys come from a bounded sample of keys (at most ``SPLIT_SAMPLE``) and only balance work;
the number of ranges grows with the number of captures.

Defined cases: null html is an empty payload; a null url has no target header and an empty key;
null page ids are written as ``none`` and read back as null; of equal payloads all rows with the
smallest page id are responses (so a repeated row is a response too), and if every page id is
null all of them are; an empty table gives no archive and an empty index; extra columns are
ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import math
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_path

# The base32 alphabet.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
RECORD_END = "\r\n\r\n"
RECORDS_PER_FILE = 20_000
#: Payloads below this many bytes are always written as responses.
LEAST_REVISIT_BYTES = 0
CAPTURES_PER_RANGE = 50_000
SPLIT_SAMPLE = 10_000
FIRST_CAPTURE = 1704067200  # capture times of pages that state none: this second plus the page id
# The seconds a date of four-digit years can tell; times outside count as the nearest of them.
FIRST_SECOND, LAST_SECOND = -62135596800, 253402300799


def base32_sha1(text: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a text, from its hexadecimal digits."""
    digits = F.sha1(text)
    letters = []
    for group in range(8):  # 5 hexadecimal digits are 4 letters
        number = F.conv(F.substring(digits, 5 * group + 1, 5), 16, 10).cast("int")
        letters += [F.substr(F.lit(BASE32), F.shiftright(number, 15 - 5 * k).bitwiseAND(31) + 1, F.lit(1)) for k in range(4)]
    return F.concat(*letters)


def url_key(url: Column) -> Column:
    """Sort-friendly key: host labels reversed, then path and query; empty without a host."""
    rest = F.regexp_extract(url, r"(?s)^[^:/?#]+://(.*)$", 1)
    host = F.lower(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1))
    tail = F.regexp_extract(rest, r"(?s)^[^/?#]*([^#]*)", 1)
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(tail == "", "/").otherwise(tail))
    return F.coalesce(F.when(rest != "", key), F.lit(""))


def _second_of(page: Column) -> Column:
    """Capture second of a page that states none, rising with the id as far as dates go."""
    return F.lit(FIRST_CAPTURE) + F.greatest(F.lit(0), F.least(F.coalesce(page, F.lit(0)), F.lit(LAST_SECOND - FIRST_CAPTURE)))


def _utc_text(second: Column) -> Column:
    """A second as date and time of UTC, whatever the zone of the session."""
    kept = F.greatest(F.lit(FIRST_SECOND), F.least(second, F.lit(LAST_SECOND)))
    since = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), kept.cast("decimal(18,6)"))
    return (F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")) + since).cast("string")


def planned(pages: DataFrame, page_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            time_col: str | None = None, least_bytes: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """Pages with digest, key, capture second and the page that their payload was first seen on."""
    page = F.col(page_col).cast("bigint")
    second = _second_of(page) if time_col is None else F.col(time_col).cast("bigint")
    rows = pages.select(
        page.alias("page"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"),
        F.coalesce(second, F.lit(FIRST_CAPTURE)).alias("second"),
    )
    rows = rows.withColumn("digest", base32_sha1(F.col("html"))).withColumn("bytes", F.octet_length("html").cast("bigint"))
    first = rows.groupBy("digest").agg(F.min("page").alias("first"))
    joined = rows.join(first, "digest")
    revisit = (F.col("bytes") >= least_bytes) & ~F.col("page").eqNullSafe(F.col("first"))
    return joined.withColumn("refers", F.when(revisit, F.coalesce(F.col("first").cast("string"), F.lit("none"))))


def _record(line: str = "\r\n") -> Column:
    """The record of a planned page, without its end."""
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{line}Content-Type: text/html; charset=utf-8{line}Content-Length: "), F.col("bytes").cast("string"), F.lit(line + line)
    )
    body = F.when(F.col("refers").isNull(), F.col("html")).otherwise("")
    target = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    day = F.concat(F.translate(_utc_text(F.col("second")), " ", "T"), F.lit("Z"))
    head = F.concat_ws(
        line,
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(F.col("refers").isNull(), "response").otherwise("revisit")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("page").cast("string"), F.lit("none")), F.lit(">")),
        F.concat(F.lit("WARC-Date: "), day),
        F.concat(F.lit("WARC-Target-URI: "), target),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(
            F.col("refers").isNotNull(),
            F.concat(
                F.lit(f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{line}WARC-Refers-To: <urn:page:"),
                F.col("refers"), F.lit(">"),
            ),
        ),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), (F.octet_length(http) + F.octet_length(body)).cast("string")),
    )
    return F.concat(head, F.lit(line + line), http, body)


def write_archives(pages: DataFrame, path: str, **columns) -> None:
    """Write one record per page under ``path``."""
    lines = planned(pages, **columns).select(_record().alias("value"))
    lines.write.option("lineSep", RECORD_END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


class ArchiveError(ValueError):
    """An archive that does not follow the format, or a payload that is not its digest's."""


def parse_archive(stream):
    """(offset, headers, block) of every record of an uncompressed stream."""
    offset = 0
    while True:
        first = stream.readline()
        if not first:
            return
        if not first.startswith(b"WARC/"):
            raise ArchiveError(f"no record at {offset}")
        headers, size = {}, len(first)
        for line in iter(stream.readline, b"\r\n"):
            if not line.endswith(b"\r\n"):
                raise ArchiveError(f"header cut off in the record at {offset}")
            size += len(line)
            name, _, value = line.decode().partition(":")
            headers[name.lower()] = value.strip()
        length = int(headers["content-length"])
        block = stream.read(length)
        if len(block) != length or stream.read(4) != RECORD_END.encode():
            raise ArchiveError(f"record at {offset} is cut off")
        yield offset, headers, block
        offset += size + 2 + length + 4


def _page(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def _capture(name: str, offset: int, headers: dict, block: bytes) -> dict:
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = headers["warc-payload-digest"].removeprefix("sha1:")
    size = int(re.search(rb"(?im)^content-length: *(\d+)", http)[1])
    if headers["warc-type"] == "response":
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if digest != stated or len(payload) != size:
            raise ArchiveError(f"{name}: the payload at {offset} is not the one of its headers")
    return {
        "url": headers.get("warc-target-uri"),
        "stamp": re.sub(r"\D", "", headers["warc-date"]),
        "page": _page(headers["warc-record-id"]),
        "bytes": size,
        "digest": stated,
        "type": headers["warc-type"],
        "refers": _page(headers.get("warc-refers-to")),
        "file": name,
        "offset": offset,
    }


def python_key(url: str | None) -> str:
    """``url_key`` of a url that was read back."""
    found = re.fullmatch(r"(?s)[^:/?#]+://(.+)", url or "")
    if not found:
        return ""
    host, tail = re.fullmatch(r"(?s)([^/?#]*)([^#]*).*", found[1]).groups()
    return ",".join(reversed(host.lower().split("."))) + ")" + (tail or "/")


def _sort_key(capture: dict) -> tuple:
    page = capture["page"]
    return capture["key"], capture["stamp"], page is not None, page or 0, capture["file"], capture["offset"]


CAPTURE = pa.schema(
    [("key", pa.string()), ("stamp", pa.string()), ("page", pa.int64()), ("url", pa.string()), ("bytes", pa.int64()), ("digest", pa.string()),
     ("type", pa.string()), ("refers", pa.int64()), ("file", pa.string()), ("offset", pa.int64())]
)
INDEX_SCHEMA = """part int, position long, key string, stamp string, page long, url string, bytes long, digest string,
    type string, refers long, file string, offset long"""


def _runs(splits: list[tuple]):
    """Each archive as a sorted run, cut at the split keys: rows (part, run)."""
    from bisect import bisect_left

    def runs(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                with gzip.open(io.BytesIO(content.as_buffer())) as stream:
                    captures = [_capture(name, *record) for record in parse_archive(stream)]
                for capture in captures:
                    capture["key"] = python_key(capture["url"])
                captures.sort(key=_sort_key)
                parts: dict[int, list] = {}
                for capture in captures:
                    parts.setdefault(bisect_left(splits, _sort_key(capture)[:4]), []).append(capture)
                yield pa.RecordBatch.from_pydict(
                    {"part": pa.array(list(parts), pa.int32()), "run": pa.array([_packed(p) for p in parts.values()], pa.binary())}
                )

    return runs


def _packed(captures: list[dict]) -> bytes:
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, CAPTURE) as writer:
        writer.write_table(pa.Table.from_pylist(captures, CAPTURE))
    return sink.getvalue()


class LoserTree:
    """K-way merge of sorted lists: inner nodes keep the loser of their match.

    After the winner is taken, its run's next item replays only the matches on its way to the
    top: one comparison per level.
    """

    _END = (1,)

    def __init__(self, runs: list[list], key):
        self.runs, self.key = runs, key
        self.at = [0] * len(runs)
        self.leaves = len(runs)
        self.front = [self._front(run) for run in range(self.leaves)]
        self.losers = [-1] * max(1, self.leaves)
        for run in range(self.leaves):
            self._enter(run)

    def _front(self, run: int) -> tuple:
        place = self.at[run]
        return (0, self.key(self.runs[run][place]), run) if place < len(self.runs[run]) else self._END + (run,)

    def _enter(self, run: int) -> None:
        """First fill: a run waits at the first empty match on its way, or plays on."""
        node = (run + self.leaves) // 2
        while node > 0:
            if self.losers[node] < 0:
                self.losers[node] = run
                return
            if self.front[self.losers[node]] < self.front[run]:
                run, self.losers[node] = self.losers[node], run
            node //= 2
        self.losers[0] = run

    def __iter__(self):
        while self.leaves:
            run = self.losers[0]
            if self.at[run] >= len(self.runs[run]):
                return
            yield self.runs[run][self.at[run]]
            self.at[run] += 1
            self.front[run] = self._front(run)
            node = (run + self.leaves) // 2
            while node > 0:
                if self.front[self.losers[node]] < self.front[run]:
                    run, self.losers[node] = self.losers[node], run
                node //= 2
            self.losers[0] = run


def _merge(table: pa.Table) -> pa.Table:
    runs = [pa.ipc.open_stream(run).read_all().to_pylist() for run in table.column("run").to_pylist()]
    merged = pa.Table.from_pylist(list(LoserTree(runs, _sort_key)), CAPTURE)
    part = pa.array([table.column("part")[0].as_py()] * merged.num_rows, pa.int32())
    place = pa.array(range(merged.num_rows), pa.int64())
    return pa.table([part, place, *merged.columns], names=["part", "position", *merged.column_names])


def split_keys(pages: DataFrame, page_col: str = "page_id", url_col: str = "url") -> list[tuple]:
    """Keys that cut the captures into ranges, from a bounded sample chosen by digest."""
    rows = pages.count()
    ranges = max(1, math.ceil(rows / CAPTURES_PER_RANGE))
    if ranges == 1:
        return []
    page = F.col(page_col).cast("bigint")
    stamp = F.regexp_replace(_utc_text(_second_of(page)), r"\D", "")
    every = max(1, rows // (SPLIT_SAMPLE // 2))
    chosen = pages.select(F.col(url_col).cast("string").alias("url"), page.alias("page"), stamp.alias("stamp"))
    chosen = chosen.where(F.pmod(F.xxhash64("page", "url"), F.lit(every)) == 0).limit(SPLIT_SAMPLE)
    keys = sorted((python_key(r.url), r.stamp, r.page is not None, r.page or 0) for r in chosen.collect())
    return sorted({keys[len(keys) * k // ranges] for k in range(1, ranges)}) if keys else []


def read_index(spark: SparkSession, path: str, splits: list[tuple]) -> DataFrame:
    """The globally ordered capture history of the archives under ``path``.

    Rows ordered by (part, position) are in order of key, time and page id.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt.gz").load(path).select("path", "content")
    runs = files.mapInArrow(_runs(splits), "part int, run binary")
    return runs.groupBy("part").applyInArrow(_merge, INDEX_SCHEMA)


def archive_and_index(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write all pages as archives, read them back and return their merged capture index."""
    spark = pages.sparkSession
    path = path or shared_path(spark, "warc")
    write_archives(pages, path)
    return read_index(spark, path, split_keys(pages))


def oracle() -> str:
    letters = " || ".join(
        f"substr('{BASE32}', ((('0x' || substr(h, {5 * g + 1}, 5))::INT >> {15 - 5 * k}) & 31) + 1, 1)" for g in range(8) for k in range(4)
    )
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS low FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, {letters} AS payload_digest,
    CASE WHEN page_id = low THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> low THEN low END AS refers_to
FROM f
"""
