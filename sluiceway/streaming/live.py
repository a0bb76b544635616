"""Metrics of running queries: what they observe and how they get on, served in the text format of Prometheus."""

from __future__ import annotations

import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql.streaming.listener import StreamingQueryListener


def process_bytes() -> dict[str, int]:
    """Memory of this process by kind, where the system tells it: resident, at most, and virtual."""
    names = {"VmRSS": "resident", "VmHWM": "resident_most", "VmSize": "virtual"}
    try:
        with open("/proc/self/status") as f:
            said = dict(line.split(":", 1) for line in f if ":" in line)
    except OSError:
        return {}
    return {n: int(said[k].split()[0]) * 1024 for k, n in names.items() if k in said}


class LiveMetrics(StreamingQueryListener):
    """Counters over all micro-batches of all queries of the session: ``spark.streams.addListener(LiveMetrics())``.

    Each number that a query observes (``df.observe(name, ...)``, see ``operators.metrics.observed_stream``) adds to the counter ``<name>_<column>_total``,
    labelled with the query's name; rows, micro-batches and seconds of each query are counted, too, and failures of queries that ended by one.
    """

    def __init__(self) -> None:
        self.lock, self.counts = threading.Lock(), {}

    def add(self, name: str, query: str | None, value: float) -> None:
        with self.lock:
            self.counts[name, query] = self.counts.get((name, query), 0) + value

    def onQueryStarted(self, event) -> None:
        self.add("queries_started_total", event.name, 1)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.add("batches_total", p.name, 1)
        self.add("rows_total", p.name, p.numInputRows)
        self.add("batch_seconds_total", p.name, p.batchDuration / 1000)
        for name, row in p.observedMetrics.items():
            for column, value in row.asDict().items():
                if isinstance(value, (int, float)):
                    self.add(f"{name}_{column}_total", p.name, value)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.add("queries_failed_total" if event.exception else "queries_stopped_total", None, 1)

    def text(self) -> str:
        """All samples in order, in the text format."""
        quoted = lambda q: q.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n")
        with self.lock:
            known = sorted(self.counts.items(), key=lambda x: (x[0][0], x[0][1] or ""))
        lines = [f"{n}{{query=\"{quoted(q)}\"}} {v:g}" if q else f"{n} {v:g}" for (n, q), v in known]
        return "\n".join([*lines, *(f"process_bytes{{kind=\"{k}\"}} {v}" for k, v in process_bytes().items())]) + "\n"


def serve(metrics: LiveMetrics, port: int = 0, host: str = "0.0.0.0") -> ThreadingHTTPServer:
    """Serves the metrics from the driver, whatever the path, until ``shutdown()``; ``server_address`` tells the port."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:  # noqa: N802
            body = metrics.text().encode()
            self.send_response(200)
            self.send_header("Content-Type", "text/plain; version=0.0.4")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args) -> None:
            pass

    server = ThreadingHTTPServer((host, port), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server
