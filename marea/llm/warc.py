"""WARC archives and their global capture index by external merge.

Each task writes its pages to one archive in the shared folder, a gzip member per record; pages whose payload another
record already holds become revisits. Reading an archive yields a locally sorted run of captures. The runs are cut by
ranges of (URL key, timestamp, id), and each range merges its slices of all runs with a loser tree, so that the written
index is one globally ordered capture history.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime
from urllib.parse import quote, urlsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import filesystem, hot_join, likely, new_dir, written

#: Payloads of fewer bytes are stored again rather than referred to.
LEAST = 100
#: Captures that one task merges, about.
RANGE = 200_000
CAPTURE = "url_key string, timestamp string, page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, file string, offset long, length long"


def url_key(url: str | None) -> str:
    """A sort key that puts hosts by their reversed labels: com,example)/path?query, lower-cased, scheme, www and port left out; null is empty."""
    parts = urlsplit(re.sub(r"[\s\[\]]", "", url or ""))
    host = re.sub(r"^www\d*\.", "", re.sub(r"^.*@|:\d*$", "", parts.netloc.lower()))
    tail = parts.path.lower() + (f"?{parts.query.lower()}" if parts.query else "")
    return f"{','.join(reversed(host.split('.')))}){tail or '/'}" if host else tail


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A gzipped WARC/1.1 record; the page's id is in the record's URN and, as seconds, in its date. A revisit keeps the HTTP header, which tells the payload's size."""
    name = lambda i: "<urn:page:none>" if i is None else f"<urn:page:{i}>"
    date = datetime.fromtimestamp(1_500_000_000 + (page_id or 0) % 10**9, UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~-._')}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"]
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + (payload if refers_to is None else b"")
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    z = zlib.compressobj(2, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + z.flush()


def records(uri: str, step: int = 1 << 20) -> Iterator[tuple[int, int, dict, dict, bytes]]:
    """(offset, length, headers, HTTP headers, payload) of an archive's records; one record is held at a time."""
    store, path = filesystem(uri)
    with store.open_input_stream(path, compression=None) as f:
        offset, raw = 0, f.read(step)
        while raw:
            z, out, read = zlib.decompressobj(31), [], 0
            while not z.eof:
                if not raw and not (raw := f.read(step)):
                    raise EOFError(f"{uri} ends within a record")
                out.append(z.decompress(raw))
                read += len(raw) - len(z.unused_data)
                raw = z.unused_data
            head, _, rest = b"".join(out).partition(b"\r\n\r\n")
            fields = lambda raw: dict(line.split(": ", 1) for line in raw.decode().split("\r\n")[1:])
            http, _, payload = rest[: int(fields(head)["Content-Length"])].partition(b"\r\n\r\n")
            yield offset, read, fields(head), fields(http), payload
            offset += read
            raw = raw or f.read(step)


class LoserTree:
    """Merges sorted sequences: inner nodes keep the loser of their match, the root the overall winner."""

    def __init__(self, runs: Iterable[Iterable[tuple]]):
        self.runs = [iter(r) for r in runs]
        self.heads = [next(r, None) for r in self.runs]
        self.k = len(self.runs)
        self.losers = [-1] * max(1, self.k)
        for run in range(self.k):
            self._play(run)

    def _play(self, run: int) -> None:
        node = (run + self.k) // 2
        while node:
            if self.losers[node] < 0:  # still being built: wait here for the opponent
                self.losers[node] = run
                return
            if not self._wins(run, self.losers[node]):
                run, self.losers[node] = self.losers[node], run
            node //= 2
        self.losers[0] = run

    def _wins(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None
        return (x, a) <= (y, b)

    def __iter__(self) -> Iterator[tuple]:
        while self.k and (head := self.heads[self.losers[0]]) is not None:
            run = self.losers[0]
            yield head
            self.heads[run] = next(self.runs[run], None)
            self._play(run)


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The archives' file names, as a written table. Null payloads are empty; a row of null id is a response."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    seen = pages.where(F.octet_length(html) >= LEAST).select(F.col(id_col).cast("long").alias("i"), F.sha2(html.cast("binary"), 256).alias("d"))
    seen = written(seen, "digests")
    firsts = seen.groupBy("d").agg(F.min("i").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    revisits = written(hot_join(seen, firsts, "d", seen.count()).where("i != first").select("i", "d", F.col("first").alias("r")).distinct(), "revisits")
    planned = pages.select(F.col(id_col).cast("long").alias("i"), F.col(url_col).alias("u"), html.alias("h"), F.sha2(html.cast("binary"), 256).alias("d"))
    planned = likely(planned, "i", revisits, keep_rest="some")  # only pages that may be revisits are shuffled
    whole = planned.where("not some").select("i", "u", "h", F.lit(None).cast("long").alias("r"))
    planned = whole.unionByName(planned.where("some").join(revisits, ["i", "d"], "left").select("i", "u", "h", "r"))
    store, path = filesystem(f"{folder}/archives")
    store.create_dir(path, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, uri = None, f"{folder}/archives/{uuid.uuid4().hex}.warc.gz"
        for batch in batches:
            if file is None and batch.num_rows:
                s, p = filesystem(uri)
                file = s.open_output_stream(p, compression=None)
            for i, u, h, r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = h.encode()
                file.write(record(i, u, payload, hashlib.sha256(payload).hexdigest(), r))
        if file is not None:
            file.close()
            yield pa.record_batch([pa.array([uri])], ["file"])

    return written(planned.mapInArrow(run, "file string"), "archives")


def captures(files: DataFrame) -> DataFrame:
    """The captures of archives, each file's as a sorted run (run, seq and the columns of CAPTURE); payloads are read again, and digests taken of them."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = lambda urn: None if urn is None or urn == "<urn:page:none>" else int(urn[10:-1])
        for batch in batches:
            for uri in batch["file"]:
                rows = []
                for offset, length, h, http, payload in records(uri):
                    whole = h["WARC-Type"] == "response"
                    digest = hashlib.sha256(payload).hexdigest() if whole else h["WARC-Payload-Digest"].removeprefix("sha256:")
                    rows.append((url_key(h.get("WARC-Target-URI")), h["WARC-Date"], number(h["WARC-Record-ID"]), h["WARC-Type"], len(payload) if whole else int(http["Content-Length"]), digest, number(h.get("WARC-Refers-To")), uri, offset, length))
                rows.sort(key=lambda r: (r[0], r[1], r[2] is not None, r[2], r[8]))
                names = [f.split()[0] for f in CAPTURE.split(", ")]
                out = pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "payload_bytes": "Int64", "refers_to": "Int64"})
                out.insert(0, "seq", range(len(out)))
                out.insert(0, "run", uri)
                yield out

    dealt = files.repartition(max(1, files.count()), "file")  # by number: adaptive merging would see only names, not what they stand for
    return written(dealt.mapInPandas(read, f"run string, seq long, {CAPTURE}"), "runs")


def merge_runs(runs: DataFrame) -> DataFrame:
    """All captures in order of (url_key, timestamp, page_id), as a written table whose files follow each other.

    Ranges are as many as the captures need to have about RANGE each, so a task holds the like of that, whatever the size.
    """
    names = [f.split()[0] for f in CAPTURE.split(", ")]

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slices = [s for b in batches for _, s in b.groupby("run", sort=False)]
        if not slices:
            return
        by_run: dict[str, list] = {}
        for s in slices:
            by_run.setdefault(s["run"].iloc[0], []).append(s)
        key = lambda f: ((k, t, not pd.isna(p), 0 if pd.isna(p) else p, o, n) for k, t, p, o, n in zip(f["url_key"], f["timestamp"], f["page_id"], f["offset"], f.index, strict=True))
        frame = pd.concat([s for parts in by_run.values() for s in parts], ignore_index=True)
        at, ordered = 0, []
        cursors = []
        for parts in by_run.values():
            n = sum(map(len, parts))
            cursors.append(key(frame.iloc[at : at + n]))
            at += n
        ordered = [head[-1] for head in LoserTree(cursors)]
        yield frame.iloc[ordered][names].astype({"page_id": "Int64", "payload_bytes": "Int64", "refers_to": "Int64"})

    parts = max(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // RANGE))
    ranged = runs.repartitionByRange(parts, "url_key", "timestamp", "page_id", "offset").sortWithinPartitions("run", "seq")
    return written(ranged.mapInPandas(merge, CAPTURE), "history")


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Every page written to archives and read back: page_id, payload_bytes, payload_digest, record_type, refers_to, and its place in the index.

    Of records with equal payloads of at least LEAST bytes, that with the smallest id is the response; rows that repeat
    its id and payload are responses too. A revisit's size is read from the HTTP header it keeps.
    """
    history = merge_runs(captures(write_archives(pages, new_dir(pages.sparkSession, "warc"), id_col, url_col, html_col)))
    return history.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "timestamp", "file", "offset", "length")
