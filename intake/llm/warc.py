"""WARC archives with revisit records, and one capture index merged from sorted runs.

Pages are written as gzip members, one record each. Of the records with equal payloads of at least `least` bytes that with the largest
page_id is a response and the others are revisits that name it; smaller payloads are all responses. Each archive has a run beside
it: one line a capture, sorted by URL key (host labels reversed, then path and query) and time. The runs meet in k-way merges by a
loser tree: split points cut the key space in ranges, a task seeks its range in each run by binary search, holds one line of each
run, and writes one sorted part. More than `fan_in` runs are merged in rounds. The split points come from a bounded sample of
lines and only balance the tasks; ties go by time, then page_id, so one URL's captures may be split among tasks.

Pages have no capture time of their own; without a `captured` column it is 2024-01-01 plus page_id seconds.

Edge cases: a null html is an empty payload; a null URL has key "-" and no target; rows that share page_id and payload with the response are
responses too; a null page_id is never the largest, and if no row of a payload has one all of them are responses; repeated rows are
written once each; an empty table gives no archives and empty results; other columns are ignored.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_folder, spread_join, stored

_EPOCH = datetime.datetime(2024, 1, 1)
_NAME = "urn:intake-page:"


class LoserTree:
    """Merges sorted iterators: inner nodes keep the loser of their match, the winner stands at the top; a step replays one path."""

    def __init__(self, runs: list[Iterator[bytes]]):
        self.runs = runs
        self.k = max(1, len(runs))
        self.heads = [next(r, None) for r in runs] or [None]
        self.losers = [-1] * self.k
        for i in range(self.k):
            self._play(i)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or x is not None and (x, a) < (y, b)

    def _play(self, run: int) -> None:
        """From leaf `run` upwards; a place without a loser yet waits for its second player."""
        node = (run + self.k) // 2
        while node:
            if self.losers[node] < 0:
                self.losers[node] = run
                return
            if self._before(self.losers[node], run):
                self.losers[node], run = run, self.losers[node]
            node //= 2
        self.losers[0] = run

    def __iter__(self) -> Iterator[bytes]:
        while self.heads[self.losers[0]] is not None:
            run = self.losers[0]
            yield self.heads[run]
            self.heads[run] = next(self.runs[run], None)
            node = (run + self.k) // 2
            while node:
                if self._before(self.losers[node], run):
                    self.losers[node], run = run, self.losers[node]
                node //= 2
            self.losers[0] = run


def _plain(url: str) -> str:
    """Without spaces and controls, which would break lines of headers and runs."""
    return re.sub(r"[\x00-\x20\x7f\x85\xa0\u2028\u2029]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)


def url_key(url: str | None) -> str:
    if not url:
        return "-"
    rest = _plain(url).lower()
    rest = rest.partition("://")[2] or rest
    rest = rest.partition("#")[0]
    host = re.match(r"[^/?]*", rest)[0]
    name, _, port = host.rpartition("@")[2].partition(":")
    labels = ",".join(reversed(name.removeprefix("www.").split(".")))
    return f"{labels}{':' + port if port not in ('', '80', '443') else ''}){rest[len(host) :] or '/'}"


def _record(kind: str, page_id: int | None, url: str | None, when: str, digest: str, payload: bytes, refers_to: int | None) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{_NAME}{page_id}>", f"WARC-Date: {when[:4]}-{when[4:6]}-{when[6:8]}T{when[8:10]}:{when[10:12]}:{when[12:]}Z"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_plain(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_NAME}{refers_to}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def parse(member: bytes) -> dict:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url of one gzip member. Raises ValueError if it is damaged."""
    try:
        data = zlib.decompress(member, 31)
    except zlib.error as e:
        raise ValueError(f"a record is damaged: {e}") from e
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(fields["Content-Length"])]
    if first != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("not a whole record")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError("a payload does not have its digest")
    number = lambda name: None if name in (None, "None") else int(name)
    named = lambda x: number(x[1:-1].removeprefix(_NAME)) if x else None
    return {"page_id": named(fields["WARC-Record-ID"]), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": named(fields.get("WARC-Refers-To")), "url": fields.get("WARC-Target-URI")}


def decide(pages: DataFrame, least: int = 1000) -> DataFrame:
    """pages (page_id, url, html, when) with digest and refers_to (null: the record is a response)."""
    html = F.coalesce(F.col("html").cast("binary"), F.lit("").cast("binary"))
    when = F.col("captured").cast("timestamp_ntz") if "captured" in pages.columns else None
    moment = F.date_format(when, "yyyyMMddHHmmss") if when is not None else F.lit(None).cast("string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), moment.alias("when"))
    rows = rows.withColumn("digest", F.sha1("html"))
    sized = rows.where(F.octet_length("html") >= least).select("page_id", "digest")
    best = sized.groupBy("digest").agg(F.max("page_id").alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1 AND best IS NOT NULL")
    met = spread_join(sized, best.drop("n"), "digest", counts=best.select("digest", F.col("n").alias("_n")))  # one error page may be a third of all
    again = met.where("page_id IS NULL OR page_id <> best").select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), F.col("best").alias("refers_to")).distinct()
    met = rows.join(again, rows["page_id"].eqNullSafe(again["_page"]) & (rows["digest"] == again["_digest"]), "left")
    return met.select("page_id", "url", "html", "when", "digest", "refers_to")


def write_archives(pages: DataFrame, root: str, least: int = 1000, archive_bytes: int = 64 << 20) -> DataFrame:
    """Archives and their runs under `root` (a URI that all executors reach). Returns run, n, lines (a sample of its lines)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(root)
        store.create_dir(folder, recursive=True)
        context = TaskContext.get()
        done: list[tuple] = []
        out, lines, size = None, [], 0

        def close() -> None:
            nonlocal out, lines, size
            if out is None:
                return
            out.close()
            lines.sort()
            with store.open_output_stream(f"{folder}/.{name}-{context.taskAttemptId()}.cdx") as index:
                index.write(b"".join(lines))
            store.move(f"{folder}/.{name}-{context.taskAttemptId()}.cdx", f"{folder}/{name}.cdx")
            store.move(f"{folder}/.{name}-{context.taskAttemptId()}.warc.gz", f"{folder}/{name}.warc.gz")
            done.append((f"{name}.cdx", len(lines), [x.rstrip(b"\n") for x in lines[:: max(1, len(lines) // 32)]]))
            out, lines, size = None, [], 0

        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, payload, when, digest, refers_to = (c[i].as_py() for c in batch.columns)
                if out is None:
                    name = f"capture-{context.partitionId():07d}-{len(done):05d}"
                    out = store.open_output_stream(f"{folder}/.{name}-{context.taskAttemptId()}.warc.gz", compression=None)
                when = when or (_EPOCH + datetime.timedelta(seconds=(page_id or 0) % 10**9)).strftime("%Y%m%d%H%M%S")
                member = _gzip(_record("revisit" if refers_to is not None else "response", page_id, url, when, digest, payload, refers_to))
                lines.append(f"{url_key(url)} {when} {'-' if page_id is None else format(page_id, '020d')} {name}.warc.gz {size:020d} {len(member)}\n".encode())
                out.write(member)
                size += len(member)
                if size >= archive_bytes:
                    close()
        close()
        runs, counts, samples = zip(*done) if done else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(runs, pa.string()), pa.array(counts, pa.int64()), pa.array(samples, pa.list_(pa.binary()))], names=["run", "n", "lines"])

    return stored(decide(pages, least).mapInArrow(run, "run string, n long, lines array<binary>"), "runs")


def _from(stream, size: int, low: bytes) -> None:
    """Puts a sorted file at its first line that is not before `low`."""
    a, b = 0, size
    while a < b:  # the answer's line begins in [a, b]
        mid = (a + b) // 2
        stream.seek(mid)
        if mid:
            stream.seek(mid - 1)
            _line(stream)
        at = stream.tell()
        line = _line(stream)
        if not line or line.rstrip(b"\n") >= low:
            b = mid
        else:
            a = max(mid + 1, at + len(line))
    stream.seek(a)
    if a:
        stream.seek(a - 1)
        _line(stream)


def _line(stream) -> bytes:
    parts = []
    while True:
        at = stream.tell()
        chunk = stream.read(4096)
        cut = chunk.find(b"\n") + 1
        if cut:
            parts.append(chunk[:cut])
            stream.seek(at + cut)
            return b"".join(parts)
        if not chunk:
            return b"".join(parts)
        parts.append(chunk)


def _lines(store, path: str, low: bytes | None, high: bytes | None, buffer: int = 1 << 16) -> Iterator[bytes]:
    with store.open_input_file(path) as stream:
        if low is not None:
            _from(stream, stream.size(), low)
        rest = b""
        while chunk := stream.read(buffer):
            *whole, rest = (rest + chunk).split(b"\n")
            for line in whole:
                if high is not None and line >= high:
                    return
                yield line


def _merge(jobs: DataFrame, root: str, number: int, splits: list[bytes], step: int) -> DataFrame:
    """jobs: g, part, members. Each becomes one sorted file of its members' lines in the part's range, `step` of those between splits. part, g, run, n."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(root)
        attempt = TaskContext.get().taskAttemptId()
        for pdf in frames:
            for g, part, members in zip(pdf["g"], pdf["part"], pdf["members"]):
                low = splits[part * step - 1] if part else None
                high = splits[end] if (end := (part + 1) * step - 1) < len(splits) else None
                name, n = f"merged-{number:02d}-{g:06d}-{part:06d}.cdx", 0
                with store.open_output_stream(f"{folder}/.{name}-{attempt}") as out:
                    for line in LoserTree([_lines(store, f"{folder}/{m}", low, high) for m in members]):
                        out.write(line + b"\n")
                        n += 1
                store.move(f"{folder}/.{name}-{attempt}", f"{folder}/{name}")
                yield pd.DataFrame({"part": [part], "g": [g], "run": [name], "n": [n]})

    tasks = int(jobs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = jobs.select("g", "part", "members").repartition(tasks, "g", "part")
    return stored(dealt.mapInPandas(run, "part int, g long, run string, n long"), "merged")


def _step(groups: int, parts: int) -> int:
    """How many parts one job of a round takes, so that the round has about `parts` jobs; a power of two, so ranges of rounds are nested."""
    step = 1
    while step < parts and groups * -(-parts // step) > 2 * parts:
        step *= 2
    return step


def merge_runs(runs: DataFrame, root: str, fan_in: int = 256, part_lines: int = 50_000, sample: int = 20_000) -> DataFrame:
    """One globally ordered index from all runs: part, run (its file), n. Parts follow each other in key order.

    Groups of about `fan_in` runs are merged, then groups of what came out, until one group is left. The fewer groups a round has, the finer are the
    ranges that it cuts them in, so a round opens each run once, or `fan_in` files for about two jobs a part, and never all runs for all parts.
    """
    total, count = runs.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    wanted = min(1 << 16, -(-total // part_lines)) or 1  # a merge holds a line a run, whatever its range: more ranges make shorter tasks only
    lines = runs.select(F.explode("lines").alias("line")).orderBy(F.xxhash64("line")).limit(max(sample, 4 * wanted))
    known = sorted(bytes(r["line"]) for r in lines.collect())
    splits = sorted({known[len(known) * i // wanted] for i in range(1, wanted)}) if known else []
    parts, groups, number = len(splits) + 1, max(1, -(-count // fan_in)), 0
    cover, step = 1 << parts.bit_length(), _step(groups, parts)
    files = runs.select((F.crc32(F.col("run").cast("binary")) % F.lit(groups)).alias("g"), F.lit(0).alias("part"), "run")
    while True:
        first = F.col("part") * F.lit(cover // step)
        ranges = F.sequence(first, F.least(first + F.lit(cover // step), F.lit(-(-parts // step))) - 1)
        jobs = files.select("g", F.explode(ranges).alias("part"), "run").groupBy("g", "part").agg(F.sort_array(F.collect_list("run")).alias("members"))
        merged = _merge(jobs, root, number, splits, step)
        if groups == 1:
            return merged.select("part", "run", "n")
        groups, number, cover = -(-groups // fan_in), number + 1, step
        step = _step(groups, parts)
        files = merged.select(F.floor(F.col("g") / F.lit(fan_in)).cast("long").alias("g"), "part", "run")


def read_captures(index: DataFrame, root: str) -> DataFrame:
    """The merged index as rows: part, position (in the part), key, time, archive, offset, size."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(root)
        for pdf in frames:
            for part, name in zip(pdf["part"], pdf["run"]):
                rows = []
                for i, line in enumerate(_lines(store, f"{folder}/{name}", None, None)):
                    key, when, _, archive, offset, size = line.decode().split(" ")
                    rows.append((part, i, key, when, archive, int(offset), int(size)))
                    if len(rows) == 20_000:
                        yield pd.DataFrame(rows, columns=["part", "position", "key", "time", "archive", "offset", "size"])
                        rows = []
                yield pd.DataFrame(rows, columns=["part", "position", "key", "time", "archive", "offset", "size"])

    tasks = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return index.select("part", "run").repartition(tasks, "part").mapInPandas(run, "part int, position long, key string, time string, archive string, offset long, size long")


def read_archives(captures: DataFrame, root: str) -> DataFrame:
    """The records that the index names, read from their archives in the order of their offsets."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(root)
        name = stream = None
        for pdf in frames:
            rows = []
            for archive, offset, size in zip(pdf["archive"], pdf["offset"], pdf["size"]):
                if archive != name:
                    if stream is not None:
                        stream.close()
                    name, stream = archive, store.open_input_file(f"{folder}/{archive}")
                stream.seek(int(offset))
                rows.append(parse(stream.read(int(size))))
            if rows:
                out = pd.DataFrame(rows)[["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]]
                yield out.astype({"page_id": "Int64", "refers_to": "Int64"})

    tasks = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = captures.select("archive", "offset", "size").repartition(tasks, "archive", F.floor(F.col("offset") / (8 << 20)))
    return dealt.sortWithinPartitions("archive", "offset").mapInPandas(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def round_trip(pages: DataFrame, least: int = 1000, **how) -> DataFrame:
    """Writes archives and runs to a new folder in the shared place, merges the runs, and reads every record through the merged index."""
    root = new_folder(pages.sparkSession, "warc")
    runs = write_archives(pages, root, least)
    return read_archives(read_captures(merge_runs(runs, root, **how), root), root)
