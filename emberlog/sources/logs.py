"""Sources: appended log files, syslog over the network, JSON lines, hits of search services."""

from __future__ import annotations


import json
import os
import socketserver
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from emberlog.operators.snapshots import excluded_path


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(source, raw): non-empty lines of the files of a directory, not of its subdirectories; source is ``file:<name>``."""
    lines = spark.read.text(path).select(F.concat(F.lit("file:"), F.element_at(F.split(F.input_file_name(), "/"), -1)).alias("source"), F.col("value").alias("raw"))
    return lines.where(F.length(F.trim("raw")) > 0)


def read_json_lines(spark: SparkSession, path: str, schema: str, at: str | None = None, since: str | None = None) -> DataFrame:
    """JSON lines with a declared schema; lines that do not parse are dropped, with a cut-off by ``at`` if given."""
    df = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return df.where(F.col(at) >= F.lit(since)) if at and since else df


def append_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def flatten_hits(responses: DataFrame, body: str) -> DataFrame:
    """(_id, _index, _score, source) of the hits in search responses held as JSON text."""
    schema = "struct<hits:struct<hits:array<struct<_id:string,_index:string,_score:double,_source:map<string,string>>>>>"
    return responses.select(F.explode(F.from_json(body, schema)["hits"]["hits"]).alias("h")).select("h._id", "h._index", "h._score", F.col("h._source").alias("source"))


def search_body(query: str, size: int = 100) -> str:
    """The request of a search: a JSON query as it is, else as a query string; newest first."""
    try:
        given = json.loads(query)
    except ValueError:
        given = None
    clause = given.get("query", given) if isinstance(given, dict) else {"query_string": {"query": query}}
    return json.dumps({"size": size, "sort": [{"@timestamp": "desc"}], "query": clause})


def flatten_indices(responses: DataFrame, body: str) -> DataFrame:
    """(index, health, docs) of index listings held as JSON text; hidden indices are left out."""
    rows = F.from_json(body, "array<map<string,string>>")
    x = responses.select(F.explode(rows).alias("r"))
    g = lambda k: F.element_at("r", F.lit(k))
    return x.select(g("index").alias("index"), g("health").alias("health"), g("docs.count").try_cast("long").alias("docs")).where("index IS NOT NULL AND NOT startswith(index, '.')")


def fired_alerts(responses: DataFrame, body: str) -> DataFrame:
    """(name, severity, triggered_at, events) of fired-alert listings held as JSON text, those without a trigger left out."""
    x = responses.select(F.explode(F.from_json(body, "struct<entry:array<struct<name:string,content:struct<severity:int,trigger_time:long,triggered_alert_count:long>>>>")["entry"]).alias("e"))
    return x.where("e.content.triggered_alert_count > 0").select("e.name", F.col("e.content.severity").alias("severity"), F.timestamp_seconds("e.content.trigger_time").alias("triggered_at"), F.col("e.content.triggered_alert_count").alias("events"))


def scan_files(spark: SparkSession, path: str, most_bytes: int = 10 << 20, excluded: list[str] | None = None, content: bool = False) -> DataFrame:
    """(path, size, modified, [content]) of a tree's files of at most ``most_bytes``; paths with any of ``excluded`` in any
    letter case, and database files, are left out. Without ``content`` the files are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    some = files.where((F.col("length") <= most_bytes) & ~excluded_path(F.col("path"), excluded or []))
    return some.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), *(["content"] if content else []))


def ingest_lines(spark: SparkSession, lines: list[str], source: str) -> DataFrame:
    """(source, raw) of lines a program hands over; blank ones are left out."""
    return spark.createDataFrame([(source, x) for x in lines if x and x.strip()], "source string, raw string")


def search_results(lines: DataFrame, line: str) -> DataFrame:
    """(raw, result) of newline-delimited search results: rows whose result has ``_raw``."""
    r = F.from_json(F.get_json_object(line, "$.result"), "map<string,string>")
    return lines.select(r.alias("result")).where(F.element_at("result", "_raw").isNotNull()).select(F.element_at("result", "_raw").alias("raw"), "result")


class _Piece(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class _TailReader(DataSourceStreamReader):
    """Offsets are bytes by file; a file that shrank is read anew. A partition is the new bytes of one file, cut at whole lines."""

    def __init__(self, options):
        self.path = options["path"]

    def _ends(self) -> dict[str, int]:
        ends = {}
        for name in sorted(os.listdir(self.path)):
            full = os.path.join(self.path, name)
            if os.path.isfile(full):
                size = os.path.getsize(full)
                with open(full, "rb") as f:  # up to the last line end
                    at = size
                    while at > 0:
                        step = min(65536, at)
                        f.seek(at - step)
                        cut = f.read(step).rfind(b"\n")
                        if cut >= 0:
                            at = at - step + cut + 1
                            break
                        at -= step
                ends[name] = at
        return ends

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return self._ends()

    def partitions(self, start: dict, end: dict):
        out = []
        for name, e in end.items():
            s = start.get(name, 0)
            if e < s:
                s = 0
            if e > s:
                out.append(_Piece(os.path.join(self.path, name), s, e))
        return out or [_Piece("", 0, 0)]

    def read(self, piece):
        if not piece.path:
            return
        with open(piece.path, "rb") as f:
            f.seek(piece.start)
            left = piece.end - piece.start
            source = "file:" + os.path.basename(piece.path)
            while left > 0:
                line = f.readline(left)
                if not line:
                    break
                left -= len(line)
                text = line.decode("utf-8", "replace").rstrip("\r\n")
                if text.strip():
                    yield (source, text)

    def commit(self, end) -> None:
        pass


class TailSource(DataSource):
    """``spark.readStream.format("emberlog-tail").load(directory)``: lines appended to the files of a shared directory."""

    @classmethod
    def name(cls) -> str:
        return "emberlog-tail"

    def schema(self) -> str:
        return "source string, raw string"

    def streamReader(self, schema):
        return _TailReader(self.options)


class SyslogCollector:
    """Receives syslog by UDP (one message a datagram of up to 64 KiB) or TCP (one a line, any number of connections at
    once) and appends it to files that ``TailSource`` reads, a file a sender. Runs from its making until ``close``.

    A socket cannot be replayed, so messages are written before they count as received; the folder should be a shared
    one. A TCP line longer than 64 KiB is written as several.
    """

    LINE = 65536

    def __init__(self, folder: str, host: str = "127.0.0.1", port: int = 0, tcp: bool = False):
        self.folder, self.messages, self.lines, self._arrived = folder, 0, 0, threading.Condition()
        collector = self

        class Handler(socketserver.BaseRequestHandler):
            def handle(self):
                peer = self.client_address[0]
                if tcp:
                    with self.request.makefile("rb") as f:
                        while line := f.readline(collector.LINE):
                            collector._write(peer, line)
                else:
                    collector._write(peer, self.request[0].replace(b"\n", b" "))
                with collector._arrived:
                    collector.messages += 1
                    collector._arrived.notify_all()

        kind = socketserver.ThreadingTCPServer if tcp else socketserver.ThreadingUDPServer
        self.server = kind((host, port), Handler, bind_and_activate=False)
        self.server.daemon_threads, self.server.allow_reuse_address, self.server.max_packet_size = True, True, self.LINE
        self.server.server_bind()
        self.server.server_activate()
        self.port = self.server.server_address[1]
        threading.Thread(target=self.server.serve_forever, args=(0.1,), daemon=True).start()

    def _write(self, peer: str, line: bytes) -> None:
        text = line.rstrip(b"\r\n")
        if text.strip():
            with self._arrived, open(os.path.join(self.folder, f"syslog-{peer.replace(':', '_')}"), "ab") as out:
                out.write(text + b"\n")
                self.lines += 1

    def receive(self, messages: int, timeout: float = 10.0) -> int:
        """Wait until so many messages (over TCP: closed connections) have come since the start; returns the lines written."""
        with self._arrived:
            self._arrived.wait_for(lambda: self.messages >= messages, timeout)
            return self.lines

    def close(self) -> None:
        self.server.shutdown()
        self.server.server_close()
