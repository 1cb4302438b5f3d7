"""WARC archives with a globally ordered capture index.

Writing gives, beside each archive, a run: its index entries sorted by URL key and time, in files of bounded size whose
first and last keys are known. Runs are then merged like the runs of an external sort. A merge task owns a range of keys,
opens the files of each run that reach into it, reads the row groups that do, and emits their entries through a loser
tree, holding one small batch of each run. When there are more runs than a task may open, groups of runs are merged into
longer ones first, range by range as well. The splitters between ranges are keys of index entries with the capture's own
id in them, so not even a single URL with most captures makes one range large.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusflow.session import persisted, scratch, prepare_workers

#: Payloads shorter than this are never written as revisits.
REVISIT_FROM = 1000
FAN_IN = 64
#: Entries that a merge task holds of each run.
BATCH = 1024
LEVEL = 6
#: Entries of a merge task's range, of a run's file and of a row group, and sampled keys that the splitters come from.
RANGE_ROWS, FILE_ROWS, GROUP_ROWS, SAMPLED = 1_000_000, 1_000_000, 1024, 200_000
ENTRY = "url_key string, captured string, page_id long, archive string, offset long, size long, payload_digest string, record_type string"
KEY = ["url_key", "captured", "page_id"]
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMESPACE = uuid.UUID("6f0a1c1e-5a52-4a0e-9d39-6c0f6c5d7a10")


# ---------------------------------------------------------------- loser tree


class LoserTree:
    """k-way merge of sorted iterators of (key, value): each inner node keeps the loser of its match.

    An item costs log k compares. Items with equal keys come in the order of their iterators.
    """

    def __init__(self, runs: Iterable[Iterator]):
        self.runs = [iter(r) for r in runs]
        self.k = len(self.runs)
        self.heads = [next(r, None) for r in self.runs]
        self.tree = [-1] * max(self.k, 1)
        for i in range(self.k):
            self._play(i)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x[0], a) < (y[0], b)

    def _play(self, i: int) -> None:
        """Plays run i up to the root; while the tree fills, a run waits at the first free node."""
        node = (i + self.k) // 2
        while node:
            other = self.tree[node]
            if other < 0:
                self.tree[node] = i
                return
            if self._before(other, i):
                self.tree[node], i = i, other
            node //= 2
        self.tree[0] = i

    def __iter__(self):
        while self.k:
            i = self.tree[0]
            if self.heads[i] is None:
                return
            yield self.heads[i]
            self.heads[i] = next(self.runs[i], None)
            self._play(i)


# ---------------------------------------------------------------- records


def url_key(url: str | None) -> str:
    """A sort key that keeps a site together: host labels reversed, then port, path and query, without the scheme."""
    if not url:
        return ")/"
    rest = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*://", "", url).split("#", 1)[0]
    host, slash, path = rest.partition("/")
    name, colon, port = host.rpartition("@")[2].partition(":")
    return ",".join(reversed(name.lower().split("."))) + colon + port + ")" + (slash + path or "/")


def record_id(page_id, captured: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page_id}/{captured}')}>"


def _line(value: str) -> str:
    """A header value on one line."""
    return re.sub(r"[\x00-\x1f\x7f]+", " ", value)


def make_record(page_id, url: str | None, captured: str, payload: bytes, digest: str, refers_to=None, refers_url: str | None = None) -> bytes:
    """A WARC/1.1 record as a gzip member of its own: a response, or a revisit when it refers to another capture."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    sha1 = base64.b32encode(bytes.fromhex(digest)).decode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, captured)}", f"WARC-Date: {captured}", f"WARC-Target-URI: {_line(url or '')}", f"WARC-Payload-Digest: sha1:{sha1}", f"WARC-Page-ID: {'' if page_id is None else page_id}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To-Target-URI: {_line(refers_url or '')}", f"WARC-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    squeeze = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + squeeze.flush()


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(headers with lower-case names, block) of one uncompressed record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = int(headers["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"record of {len(rest)} bytes should have {size} and its end")
    return headers, rest[:size]


def read_members(source) -> Iterator[tuple[int, int, bytes]]:
    """(offset, size, data) of each gzip member of an archive, read in order and in bounded pieces."""
    unzip, data, at, begun = zlib.decompressobj(31), [], 0, 0
    while block := source.read(1 << 20):
        while block:
            data.append(unzip.decompress(block))
            if not unzip.eof:
                at += len(block)
                break
            at += len(block) - len(unzip.unused_data)
            yield begun, at - begun, b"".join(data)
            block, unzip, data, begun = unzip.unused_data, zlib.decompressobj(31), [], at
    if begun != at or any(data):
        raise ValueError("archive ends inside a record")


def _open(uri: str):
    """(file system, path) of a URI; Hadoop's names of object stores are told apart from their protocols' here."""
    return pyarrow.fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", uri))


# ---------------------------------------------------------------- writing


def _decide(pages: DataFrame, revisit_from: int) -> DataFrame:
    """(digest, response_id, response_url) of payloads that more than one page has; counts are partial before they move."""
    digests = pages.where(F.octet_length("html") >= revisit_from).select(F.sha1(F.encode("html", "UTF-8")).alias("digest"), "page_id", "url")
    groups = digests.groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("top"), F.count("*").alias("n"))
    return groups.where("n > 1").select("digest", F.col("top.page_id").alias("response_id"), F.col("top.url").alias("response_url"))


def _archive(folder: str):
    """Writes the rows of a task into one archive and yields its index entries."""
    names = [x.split()[0] for x in ENTRY.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(folder)
        task = TaskContext.get()
        # Each attempt has an archive of its own, which its index entries name: those that count are always of one attempt.
        name = f"captures-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        at, sink = 0, None
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                entries: list[list] = [[] for _ in names]
                for row in batch.slice(begin, 256).to_pylist():
                    if sink is None:
                        fs.create_dir(base, recursive=True)
                        sink = fs.open_output_stream(f"{base}/{name}", compression=None)
                    payload = row["html"].encode()
                    digest = hashlib.sha1(payload).hexdigest()
                    refers = row["response_id"]
                    member = make_record(row["page_id"], row["url"], row["captured"], payload, digest, refers, row["response_url"])
                    sink.write(member)
                    kind = "response" if refers is None else "revisit"
                    for out, x in zip(entries, (url_key(row["url"]), row["captured"], row["page_id"], f"{folder}/{name}", at, len(member), digest, kind), strict=True):
                        out.append(x)
                    at += len(member)
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(entries, kinds, strict=True)], names)
        if sink is not None:
            sink.close()

    return run


def write_archives(pages: DataFrame, captured, revisit_from: int = REVISIT_FROM, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> tuple[DataFrame, str]:
    """Writes one record per row and returns (index entries, folder of the runs).

    ``captured`` is a column with the time of capture as ISO 8601 text in UTC. Each run is a Parquet file sorted by URL
    key, time and page. Of pages with equal payloads of at least ``revisit_from`` bytes that with the largest id is the
    response and the others revisit it; rows that tie in id with the response are responses too. A null payload is empty;
    a null url has the key ``)/``; a null id is written as no id and never is what others refer to while another exists.
    """
    prepare_workers(pages.sparkSession)
    spark = pages.sparkSession
    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"), F.coalesce(captured, F.lit("1970-01-01T00:00:00Z")).alias("captured"))
    shared = persisted(_decide(source, revisit_from), "digests")
    keyed = source.withColumn("key", F.when(F.octet_length("html") >= revisit_from, F.sha1(F.encode("html", "UTF-8"))))
    # Which pages revisit: decided on ids and digests alone, so the pages themselves move once.
    revisits = keyed.where("key IS NOT NULL").select("page_id", "key").join(shared, F.col("key") == F.col("digest")).where(~F.col("page_id").eqNullSafe(F.col("response_id")) & F.col("response_id").isNotNull())
    revisits = persisted(revisits.select(F.col("page_id").alias("r_id"), F.col("key").alias("r_key"), "response_id", "response_url").distinct(), "revisits")
    decided = keyed.join(revisits, F.col("page_id").eqNullSafe(F.col("r_id")) & (F.col("key") == F.col("r_key")), "left")
    folder, runs = scratch(spark, "warc"), scratch(spark, "runs")
    written = decided.select("page_id", "url", "html", "captured", "response_id", "response_url").mapInArrow(_archive(folder), ENTRY)
    _write_runs(written.sortWithinPartitions(*KEY), runs)
    return spark.read.schema(ENTRY).parquet(runs), runs


# ---------------------------------------------------------------- merging


def _write_runs(rows: DataFrame, path: str) -> None:
    """Each partition as a run: files of bounded size in order, with small row groups."""
    rows.write.option("maxRecordsPerFile", FILE_ROWS).option("parquet.block.row.count.limit", GROUP_ROWS).parquet(path)


def _entries(uris: list[str], low: tuple | None, high: tuple | None) -> Iterator[tuple]:
    """A run's entries in [low, high), as (key, row) in key order; row groups outside are skipped by their statistics."""
    for uri in uris:
        fs, path = _open(uri)
        with fs.open_input_file(path) as source:
            run = pq.ParquetFile(source)
            groups = []
            for g in range(run.num_row_groups):
                stats = run.metadata.row_group(g).column(0).statistics
                if stats is not None and stats.has_min_max and (high is not None and stats.min > high[0] or low is not None and stats.max < low[0]):
                    continue
                groups.append(g)
            for batch in run.iter_batches(BATCH, row_groups=groups) if groups else ():
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    key = _order(row)
                    if low is not None and key < low:
                        continue
                    if high is not None and key >= high:
                        return
                    yield key, row


def _order(row: tuple) -> tuple:
    """Sort key of an entry; a missing id comes first, as in Spark."""
    return row[0], row[1], row[2] is not None, row[2] or 0


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges the runs that each input row names, in its range of keys."""
    names = [x.split()[0] for x in ENTRY.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]

    def out(rows: list, job: int, first: int) -> pa.RecordBatch:
        columns = [*zip(*rows, strict=True), [job] * len(rows), range(first, first + len(rows))]
        return pa.RecordBatch.from_arrays([pa.array(list(v), k) for v, k in zip(columns, kinds, strict=True)], [*names, "range_no", "place"])

    for batch in batches:
        for row in batch.to_pylist():
            bound = [_order(tuple(row[x][k] for k in ("u", "c", "p"))) if row[x] else None for x in ("low", "high")]
            rows, done = [], 0
            for _, entry in LoserTree([_entries(uris, *bound) for uris in row["runs"]]):
                rows.append(entry)
                if len(rows) == 4096:
                    yield out(rows, row["range_no"], done)
                    done, rows = done + len(rows), []
            if rows:
                yield out(rows, row["range_no"], done)


MERGED = ENTRY + ", range_no long, place long"
_JOB = "range_no long, low struct<u:string,c:string,p:long>, high struct<u:string,c:string,p:long>, runs array<array<string>>"


def _jobs(spark, jobs: list) -> DataFrame:
    """Merge jobs, each in a partition of its own, so that what it writes is part of one run."""
    return spark.createDataFrame(spark.sparkContext.parallelize(jobs, len(jobs)), _JOB)


def _cut(keys: list[tuple], n: int) -> list[tuple | None]:
    """Bounds of n ranges with about as many of the keys in each; fewer if there aren't as many different keys."""
    keys = sorted({_order(k): k for k in keys}.items())
    cuts = sorted({keys[len(keys) * i // n] for i in range(1, n)}) if keys else []
    return [None, *(k for _, k in cuts), None]


def _plan(entries: DataFrame, run_of, range_rows: int, fan_in: int) -> tuple[list, list[int]]:
    """(merge jobs, group of each job) for the files of some runs; run_of gives the run that a file's task wrote.

    What the driver holds is one row for each file (of FILE_ROWS entries) and a bounded sample of keys.
    """
    at = F.regexp_extract(F.input_file_name(), r"part-(\d+)-", 1).cast("long")
    found = entries.select(*KEY, F.input_file_name().alias("file"), at.alias("task")).groupBy("file", "task").agg(F.min(F.struct(*KEY)).alias("low"), F.max(F.struct(*KEY)).alias("high"), F.count("*").alias("n")).collect()
    runs: dict[int, list] = {}
    for r in sorted(found, key=lambda r: _order(tuple(r["low"]))):
        runs.setdefault(run_of(r["task"]), []).append(r)
    order = sorted(runs)
    total = sum(r["n"] for r in found)
    sampled: dict[int, list] = {}
    if total > range_rows:
        for r in entries.select(*KEY, at.alias("task")).sample(min(1.0, SAMPLED / total), seed=7).collect():
            sampled.setdefault(run_of(r["task"]), []).append(tuple(r)[:3])
    jobs, groups = [], []
    for g, begin in enumerate(range(0, len(order), fan_in)):
        mine = order[begin : begin + fan_in]
        bounds = _cut([k for x in mine for k in sampled.get(x, ())], -(-sum(r["n"] for x in mine for r in runs[x]) // range_rows))
        for a, b in zip(bounds, bounds[1:], strict=False):
            reach = lambda r: (b is None or _order(tuple(r["low"])) < _order(b)) and (a is None or _order(tuple(r["high"])) >= _order(a))  # noqa: B023, E731
            lists = [[_plain_uri(r["file"]) for r in runs[x] if reach(r)] for x in mine]
            jobs.append((len(jobs), a, b, [x for x in lists if x]))
            groups.append(g)
    return jobs, groups


def _plain_uri(name: str) -> str:
    """A file's name as Spark gives it, without its percent escapes."""
    return unquote(name)


def merge_runs(entries: DataFrame, runs: str, range_rows: int = RANGE_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """The runs' entries in one global order: by range_no, and in a range by place.

    Every range but the last ends before the next one's first key (url_key, captured, page_id). Entries with equal keys
    keep the order of their runs. No runs give no rows.
    """
    spark = entries.sparkSession
    run_of = lambda task: task
    while True:
        jobs, groups = _plan(entries, run_of, range_rows, fan_in)
        if not jobs:
            return spark.createDataFrame([], MERGED)
        if groups[-1] == 0:
            return _jobs(spark, jobs).mapInArrow(_merge, MERGED)
        longer = scratch(spark, "runs")
        _write_runs(_jobs(spark, jobs).mapInArrow(_merge, MERGED).drop("range_no", "place"), longer)
        entries, run_of = spark.read.schema(ENTRY).parquet(longer), groups.__getitem__


# ---------------------------------------------------------------- reading back

READ = "archive string, offset long, page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in READ.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    for batch in batches:
        for uri in batch.column(0).to_pylist():
            fs, path = _open(uri)
            rows: list = []
            with fs.open_input_stream(path, compression=None) as source:
                for offset, _, raw in read_members(source):
                    headers, block = parse_record(raw)
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(re.search(rb"(?i)content-length: *(\d+)", http)[1])
                    digest = base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:")).hex()
                    kind = headers["warc-type"]
                    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                        raise ValueError(f"{uri} at {offset}: the payload isn't the one that was written")
                    page, refers = headers.get("warc-page-id"), headers.get("warc-refers-to-page-id")
                    rows.append((uri, offset, int(page) if page else None, kind, size, digest, int(refers) if refers else None))
                    if len(rows) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(list(v), k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(v), k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def read_archives(archives: DataFrame) -> DataFrame:
    """One row per record of the archives named in the column ``archive``; each is read in order by one task.

    Responses are checked against their length and digest; a revisit's length is that of the payload it stands for.
    """
    names = archives.select("archive").distinct()
    return names.repartition(max(1, names.count()), "archive").mapInArrow(_scan, READ)


def capture_histories(pages: DataFrame, captured, revisit_from: int = REVISIT_FROM, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", range_rows: int = RANGE_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """Writes archives, merges their runs and reads the archives back: one row per capture.

    Rows: page_id, payload_bytes, payload_digest, record_type, refers_to, url_key, captured, archive, offset, range_no and
    place; (range_no, place) is the global order by URL key, time and page. Rules for nulls and ties as in
    :func:`write_archives`; repeated rows are records of their own; no pages give no rows. Other columns are ignored.
    """
    entries, runs = write_archives(pages, captured, revisit_from, id_col, url_col, html_col)
    merged = merge_runs(entries, runs, range_rows, fan_in)
    records = read_archives(entries).select("archive", "offset", "payload_bytes", F.col("payload_digest").alias("read_digest"), F.col("record_type").alias("read_type"), "refers_to")
    # Neither side has a size that Spark could know beforehand, so neither may be broadcast. Every entry has its record and
    # every record its entry; one that hasn't is an error and not a row less.
    at = ["archive", "offset"]
    rows = merged.withColumn("indexed", F.lit(True)).hint("merge").join(records.withColumn("read", F.lit(True)).hint("merge"), at, "full_outer")
    both = F.col("indexed").isNotNull() & F.col("read").isNotNull()
    sure = lambda c, kind: F.when(both, F.col(c)).otherwise(F.raise_error(F.concat(F.lit("index and archive differ: "), F.col("archive"))).cast(kind))
    return rows.select(sure("page_id", "long").alias(id_col), sure("payload_bytes", "long").alias("payload_bytes"), F.col("read_digest").alias("payload_digest"), F.col("read_type").alias("record_type"), "refers_to", "url_key", "captured", "archive", "offset", "range_no", "place")


def with_history(rows: DataFrame) -> DataFrame:
    """Adds capture_no, a capture's number in its URL's history, from 1."""
    return rows.withColumn("capture_no", F.row_number().over(Window.partitionBy("url_key").orderBy("range_no", "place")))
