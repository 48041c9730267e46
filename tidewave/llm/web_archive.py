"""WARC archives of pages, and their index by an external merge: sorted runs, merged by a loser tree into one order of captures.

Writing: every page is one record. A payload that a page with a larger id holds too becomes a revisit of that page's record. Records are
text, so Spark's text writer makes the files, with the blank lines that end a record between them.

Reading: files are parsed by the lengths their records state. A task sorts the captures it has read into runs, which are written; evenly
spaced keys of a bounded sample cut the key space into ranges; each run sends a range its slice, and one task a range merges the slices
of all runs with a loser tree. Ranges are cut by URL key, time and record, so captures of one URL may fill many ranges.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from bisect import bisect_right
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, release, shared_folder, shuffle_partitions, tidy

# Fixed values of the format.
VERSION, LINE, END = "WARC/1.1", "\r\n", "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

#: Bytes of an archive file on average, captures of a run and of a range, and the most keys sampled to cut ranges.
FILE_BYTES, RUN, RANGE, SAMPLE = 32 << 20, 100_000, 100_000, 1_000_000
#: While there are fewer files or ranges than the session has tasks, they are cut down to this many bytes or captures.
SMALL_FILE, SMALL_RANGE = 1 << 20, 500

CAPTURE = "url_key string, captured string, record_id string, page_id long, record_type string, payload_digest string, payload_bytes long, refers_to long, block_bytes long, file string, offset long"
KEY = ("url_key", "captured", "record_id", "file", "offset")


def base32(hexed: Column) -> Column:
    """Upper-case base32 of 40 hexadecimal digits: five of them are four base32 digits."""
    groups = [F.lpad(F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def url_key(url: Column) -> Column:
    """Sort-friendly URL: host labels in reverse order without ``www``, then path and query; no scheme, user, default port or fragment."""
    plain = F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), "#.*$", "")
    rest = F.regexp_replace(plain, "^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    host = F.lower(F.regexp_replace(F.regexp_extract(rest, "^([^/?]*)", 1), "^.*@", ""))
    host = F.regexp_replace(F.regexp_replace(host, ":(80|443)$", ""), "^www[0-9]*[.]", "")
    path = F.regexp_replace(rest, "^[^/?]*", "")
    path = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    return F.when(rest == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, "[.]")), ","), F.lit(")"), path))


def header(value: Column) -> Column:
    """A value that stays on one line of a record's head."""
    return F.regexp_replace(value, "[\\r\\n]", "")


def write(pages: DataFrame, path: str, *, least_bytes: int = 0, file_bytes: int = FILE_BYTES, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", time_col: str | None = None, compression: str = "gzip") -> None:
    """Writes a record of every row of ``pages`` to files under ``path``, each a gzip stream (``compression`` "none": plain bytes).

    Of rows with equal payloads of ``least_bytes`` or more, those with the largest id become responses, others revisit it. Rows equal in
    payload and in the largest id are responses all; null ids are below any other and are not revisited unless the payload has no other id.
    A null payload is empty. ``time_col`` holds capture times; without it a page is captured as many seconds after 2024 began as its id
    says (modulo 10**9; null: 0). Line ends within URLs are taken out. An empty table gives no record. Other columns are not read.
    """
    spark = pages.sparkSession
    page, payload = F.col(id_col).cast("long"), F.coalesce(F.col(payload_col), F.lit(""))
    since = F.coalesce(F.unix_seconds(F.col(time_col).cast("timestamp")), F.lit(0)) if time_col else F.lit(1_704_067_200) + F.pmod(F.coalesce(page, F.lit(0)), F.lit(10**9))
    moment = F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), since)
    rows = pages.select(
        page.alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.concat(F.translate(F.substring(moment.cast("string"), 1, 19), " ", "T"), F.lit("Z")).alias("captured"),
        payload.alias("payload"), F.octet_length(payload).cast("long").alias("bytes"), F.upper(F.sha1(payload.cast("binary"))).alias("sha1"),
    ).withColumn("deal", F.xxhash64("id", "url"))
    slim = cut(rows.select("id", "sha1", "bytes", "deal"))
    total = slim.agg(F.sum("bytes")).first()[0] or 0
    files = max(-(-total // file_bytes), min(spark.sparkContext.defaultParallelism, -(-total // SMALL_FILE)), 1)
    # Rows of one payload are dealt over all files by the hash of their id and URL; a file gets the payload's largest id once.
    salt = F.pmod(F.col("deal"), F.lit(files)).alias("salt")
    first = slim.groupBy("sha1").agg(F.max("id").alias("original"))
    wanted = slim.select("sha1", salt).distinct().join(first, "sha1").repartition(files, "sha1", "salt")
    held = rows.withColumn("salt", salt).repartition(files, "sha1", "salt").join(wanted, ["sha1", "salt"])
    revisit = (F.col("bytes") >= least_bytes) & ~F.col("id").eqNullSafe(F.col("original"))
    digest = base32(F.col("sha1"))
    name = lambda i: F.concat(F.lit("<urn:page:"), F.coalesce(i.cast("string"), F.lit("null")), F.lit(":"), digest, F.lit(">"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{LINE}Content-Type: text/html; charset=utf-8{LINE}Content-Length: "), F.col("bytes").cast("string"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, "payload"))
    head = F.concat(
        F.lit(f"{VERSION}{LINE}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit(f"{LINE}WARC-Target-URI: "), header(F.col("url")),
        F.lit(f"{LINE}WARC-Date: "), F.col("captured"),
        F.lit(f"{LINE}WARC-Record-ID: "), name(F.col("id")),
        F.lit(f"{LINE}WARC-Payload-Digest: sha1:"), digest,
        F.when(revisit, F.concat(F.lit(f"{LINE}WARC-Profile: {REVISIT_PROFILE}{LINE}WARC-Refers-To: "), name(F.col("original")))).otherwise(""),
        F.lit(f"{LINE}WARC-URL-Key: "), header(url_key(F.col("url"))),
        F.lit(f"{LINE}Content-Type: application/http; msgtype=response{LINE}Content-Length: "), F.octet_length(block).cast("string"), F.lit(END),
    )
    held.select(F.concat(head, block).alias("value")).write.option("lineSep", END).option("compression", compression).text(path)
    release(slim)


def records(data: bytes) -> Iterator[tuple[int, dict[str, str], memoryview]]:
    """(offset, head, block) of every record in the bytes of a file, unpacked first if need be; a length that does not fit raises an error."""
    data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
    view, at = memoryview(data), 0
    while at < len(data):
        stop = data.index(END.encode(), at)
        version, *lines = data[at:stop].decode().split(LINE)
        head = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}
        body = stop + len(END)
        end = body + int(head["content-length"])
        if version != VERSION or bytes(view[end : end + len(END)]) != END.encode():
            raise ValueError(f"no record at byte {at}")
        yield at, head, view[body:end]
        at = end + len(END)


def _capture(file: str, offset: int, head: dict[str, str], block: memoryview) -> tuple:
    """The index entry of a record. Bytes and digest of a response are taken from its payload, those of a revisit from its head."""
    http, _, payload = bytes(block).partition(END.encode())
    number = lambda name: (lambda x: None if x == "null" else int(x))(head[name].split(":")[2])
    digest = head["warc-payload-digest"].removeprefix("sha1:")
    size = int(http.decode().rsplit("Content-Length: ", 1)[1])
    if head["warc-type"] == "response":
        found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if (found, len(payload)) != (digest, size):
            raise ValueError(f"{file} at byte {offset}: the payload is not the one its head states")
    refers = number("warc-refers-to") if head["warc-type"] == "revisit" else None
    return head["warc-url-key"], head["warc-date"], head["warc-record-id"].strip("<>"), number("warc-record-id"), head["warc-type"], digest, size, refers, len(block), file, offset


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64()}
    return pa.schema([(n, kinds[t]) for n, t in (c.split() for c in ddl.split(", "))])


def runs(spark: SparkSession, path: str) -> DataFrame:
    """Captures of the archives under ``path`` in sorted runs: a task parses its files and sorts ``RUN`` captures at a time."""
    schema = _arrow(f"run string, seq long, {CAPTURE}")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(held: list[tuple]) -> pa.RecordBatch:
            held.sort(key=lambda x: (*x[:3], *x[-2:]))
            run = f"{held[0][-2]}#{held[0][-1]}"
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*((run, i, *x) for i, x in enumerate(held))), schema)], schema=schema)

        held = []
        for batch in batches:
            for file, content in zip(batch.column("path"), batch.column("content")):
                for record in records(content.as_py()):
                    held.append(_capture(file.as_py(), *record))
                    if len(held) == RUN:
                        yield sent(held)
                        held = []
        if held:
            yield sent(held)
        tidy()

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(work, f"run string, seq long, {CAPTURE}")


class LoserTree:
    """Merges sorted sequences: an inner node holds the loser of its two sides, so the next item costs one path of comparisons."""

    def __init__(self, sequences: Sequence[Sequence]):
        self.items, self.at = sequences, [0] * len(sequences)
        self.losers = [-1] * len(sequences)
        for i in range(len(sequences)):
            self.replay(i)

    def before(self, a: int, b: int) -> bool:
        """Whether sequence ``a`` goes first: ended ones go last, equal items by the number of their sequence."""
        if self.at[b] >= len(self.items[b]) or self.at[a] >= len(self.items[a]):
            return self.at[a] < len(self.items[a])
        x, y = self.items[a][self.at[a]], self.items[b][self.at[b]]
        return x < y or (x == y and a < b)

    def replay(self, i: int) -> None:
        """Takes sequence ``i`` from its leaf up; while the tree is built, the first to come to a node waits there."""
        node = (i + len(self.items)) // 2
        while node:
            other = self.losers[node]
            if other < 0:
                self.losers[node] = i
                return
            if self.before(other, i):
                self.losers[node], i = i, other
            node //= 2
        self.losers[0] = i

    def __iter__(self) -> Iterator[tuple[int, int]]:
        """(sequence, place in it) in merged order."""
        while self.items and self.at[first := self.losers[0]] < len(self.items[first]):
            yield first, self.at[first]
            self.at[first] += 1
            self.replay(first)


def _splitters(captures: DataFrame, size: int) -> list[tuple]:
    """Keys that cut the captures into ranges of about ``size``: evenly spaced in a sample of ``SAMPLE`` keys about, 200 a range."""
    n = captures.count()
    ranges = max(-(-n // size), min(shuffle_partitions(captures.sparkSession), -(-n // SMALL_RANGE)))
    share = min(1.0, SAMPLE / max(n, 1), 200 * ranges / max(n, 1))
    picked = F.pmod(F.xxhash64("run", "seq"), F.lit(1 << 30)) < int(share * (1 << 30))
    keys = sorted(tuple(r) for r in captures.filter(picked).select(*KEY).toLocalIterator()) if ranges > 1 else []
    return [keys[len(keys) * i // ranges] for i in range(1, ranges)] if len(keys) >= ranges else keys


def merge(captures: DataFrame, *, size: int = RANGE) -> DataFrame:
    """All captures of sorted runs in one order, with ``position`` in it (from 0): by URL key, time, record and place."""
    splitters = _splitters(captures, size)
    plain, fields = _arrow(CAPTURE), [c.split()[0] for c in CAPTURE.split(", ")]
    slices_of = f"range int, run string, seq long, n long, captures array<struct<{', '.join(c.replace(' ', ': ') for c in CAPTURE.split(', '))}>>"

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = batch.select([*KEY]).to_pydict()
            spot = [bisect_right(splitters, key) for key in zip(*cols.values())] if splitters else [0] * batch.num_rows
            run = batch.column("run").to_pylist()
            starts = [i for i in range(len(run)) if not i or (run[i], spot[i]) != (run[i - 1], spot[i - 1])]
            if not starts:
                continue
            rows = pa.StructArray.from_arrays([batch.column(f) for f in fields], fields=list(plain))
            held = pa.ListArray.from_arrays(pa.array([*starts, len(run)], pa.int32()), rows)
            seq = batch.column("seq").to_pylist()
            sizes = [b - a for a, b in zip(starts, [*starts[1:], len(run)])]
            yield pa.RecordBatch.from_arrays([pa.array([spot[i] for i in starts], pa.int32()), pa.array([run[i] for i in starts]), pa.array([seq[i] for i in starts], pa.int64()), pa.array(sizes, pa.int64()), held], names=["range", "run", "seq", "n", "captures"])

    cuts = cut(captures.mapInArrow(slices, slices_of))
    counts = cuts.groupBy("range").agg(F.sum("n").alias("n")).orderBy("range").collect()
    begins, at = {}, 0
    for r in counts:
        begins[r["range"]], at = at, at + r["n"]

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(spot: int, held: list[pa.Array]) -> pa.RecordBatch:
            rows = pa.RecordBatch.from_struct_array(pa.concat_arrays(held))
            keys = list(zip(*(rows.column(k).to_pylist() for k in KEY)))
            edges, lists = 0, []
            for part in held:
                lists.append(keys[edges : edges + len(part)])
                edges += len(part)
            base = [0]
            for part in held:
                base.append(base[-1] + len(part))
            out = rows.take(pa.array([base[s] + i for s, i in LoserTree(lists)], pa.int64()))
            return out.append_column("position", pa.array(range(begins[spot], begins[spot] + out.num_rows), pa.int64()))

        spot, held = None, []
        for batch in batches:
            for here, part in zip(batch.column("range").to_pylist(), batch.column("captures")):
                if held and here != spot:
                    yield sent(spot, held)
                    held = []
                spot = here
                held.append(part.values)
        if held:
            yield sent(spot, held)
        tidy()

    dealt = cuts.repartition(max(len(counts), 1), "range").sortWithinPartitions("range", "run", "seq").select("range", "captures")
    out = cut(dealt.mapInArrow(merged, f"{CAPTURE}, position long"))
    release(cuts)
    return out


def archive(pages: DataFrame, *, path: str | None = None, **options) -> DataFrame:
    """Writes ``pages`` to archives under ``path`` (``write``), reads them back and gives the index of all captures in merged order."""
    spark = pages.sparkSession
    path = path or f"{shared_folder(spark)}/archives/{uuid.uuid4().hex}"
    write(pages, path, **options)
    captures = cut(runs(spark, path))
    out = merge(captures)
    release(captures)
    return out
