"""A local page over a folder of saved reports: an index, and each report as HTML. The folder is read anew for every request."""

from __future__ import annotations

import html
import ipaddress
import os
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from itertools import groupby
from urllib.parse import parse_qs, quote, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.reports import load_reports
from .render import to_html


def is_local_host(host: str | None) -> bool:
    """Whether a Host header names this machine's loopback, so that no remote page reads reports through a name of its own."""
    try:
        name = urlsplit(f"//{host or ''}").hostname or ""
        return name == "localhost" or ipaddress.ip_address(name).is_loopback
    except ValueError:
        return False


def index_rows(reports: DataFrame) -> DataFrame:
    """file_name, project, score, number of findings, date, and the tally of verdicts; by project, latest first."""
    told = lambda kind: F.size(F.filter("verdicts", lambda v: v["classification"] == kind)).cast("string")
    verdicts = F.when(F.col("verdicts").isNotNull(), F.concat(told("real"), F.lit(" real, "), told("false-positive"), F.lit(" false, "), told("uncertain"), F.lit(" open")))
    rows = reports.select("file_name", F.col("projectName").alias("project"), F.col("overallScore").alias("score"), F.size("findings").alias("n_findings"), F.col("completedAt").alias("date"), verdicts.alias("verdicts"))
    return rows.orderBy("project", F.desc_nulls_last("date"), "file_name")


def index_page(reports: DataFrame | None, folder: str) -> str:
    """A section a project, a line a report, every value escaped. reports is None where the folder does not exist."""
    told = [] if reports is None else index_rows(reports).collect()  # one short row for each file of the folder
    show = lambda x: html.escape(str(x))
    sections = []
    for project, own in groupby(told, key=lambda r: r["project"]):
        lines = [f'<li><a href="/report?f={quote(r["file_name"])}">{show(r["file_name"])}</a>: {show(r["score"])} of 10, {r["n_findings"]} findings{", judged " + show(r["verdicts"]) if r["verdicts"] else ""}, {show(r["date"] or "undated")}</li>' for r in own]
        sections.append(f"<section><h2>{show(project)}</h2><ul>{''.join(lines)}</ul></section>")
    body = "".join(sections) or "<p>No reports: save one in this folder and load the page again.</p>"
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>Saved audits</title></head><body><h1>{len(told)} reports in <code>{show(folder)}</code></h1>{body}</body></html>\n'


def report_page(reports: DataFrame | None, name: str) -> str | None:
    """A report of the folder itself as HTML; None for any other name."""
    if reports is None or not name or os.path.basename(name) != name:
        return None
    row = to_html(reports.where(F.col("file_name") == name)).first()
    return row["html"] if row else None


def respond(spark: SparkSession, folder: str, target: str, host: str | None) -> tuple[int, str, str]:
    """Status, content type and body of a request."""
    if not is_local_host(host):
        return 403, "text/plain", "forbidden"
    url = urlsplit(target)
    if url.path not in ("/", "/report"):
        return 404, "text/plain", "not found"
    reports = load_reports(spark, folder) if os.path.isdir(folder) else None
    page = index_page(reports, folder) if url.path == "/" else report_page(reports, parse_qs(url.query).get("f", [""])[0])
    return (200, "text/html", page) if page is not None else (404, "text/plain", "no such report")


def server(spark: SparkSession, folder: str, port: int = 0) -> ThreadingHTTPServer:
    """Bound to the loopback alone; the caller runs `serve_forever`."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            try:
                status, kind, body = respond(spark, folder, self.path, self.headers.get("Host"))
            except Exception as why:  # one request's failure is no other's
                status, kind, body = 500, "text/plain", type(why).__name__
            raw = body.encode()
            self.send_response(status)
            self.send_header("Content-Type", f"{kind}; charset=utf-8")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def log_message(self, *args):
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)
