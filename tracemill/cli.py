"""Command line: recorded or live logs to a text report, a page, tables or JSON.

Without --replay-logs, the command listens at the addresses for --connections programs' workers each, keeps what they send
until they close (or for --record-seconds), and analyses that.  TRACEMILL_LOG sets Spark's log level, TRACEMILL_EVENT_LOG
the folder of --dataflow-profiling.
"""

from __future__ import annotations

import argparse
import os
import sys
import time
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

from tracemill import sinks
from tracemill.functions.scalars import PALETTES
from tracemill.operators.recursion import checkpoint_dir
from tracemill.plans import render, report
from tracemill.plans.relations import Trace
from tracemill.sources import live, logs

SHELLS = ("bash", "fish", "zsh", "powershell", "elvish")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tracemill", description=__doc__)
    p.add_argument("--replay-logs", nargs="+", metavar="DIR", help="directories of recorded logs")
    p.add_argument("--stream-encoding", choices=["parquet", "json", "frames"], help="format of the logs (parquet where they are replayed, json where they are live)")
    p.add_argument("--connections", type=int, default=1, help="connections to wait for at each address")
    p.add_argument("-d", "--differential", action="store_true", help="there is an arrangement log")
    p.add_argument("-p", "--progress", action="store_true", help="there is a progress log")
    p.add_argument("--address", default="127.0.0.1:51317", help="of the engine log")
    p.add_argument("--differential-address", default="127.0.0.1:51318")
    p.add_argument("--progress-address", default="127.0.0.1:51319")
    p.add_argument("--record-seconds", type=float, help="stop listening after so long (default: when all connections have closed)")
    p.add_argument("-w", "--workers", type=int, default=0, help="partitions of the analysis (0: Spark's own)")
    p.add_argument("--palette", choices=sorted(PALETTES), default="inferno")
    p.add_argument("--color", choices=["auto", "always", "never"], default="auto", help="of the terminal's output")
    p.add_argument("--output-dir", default="trace-graph", help="folder of the page")
    p.add_argument("--page-data", metavar="DIR", help="folder of the page's whole relations (default: data in the page's folder)")
    p.add_argument("--report-file", default="report.txt")
    p.add_argument("--no-report-file", action="store_true")
    p.add_argument("--report-update-duration", type=int, metavar="SECONDS", help="write the report again every so long from what the replayed folders then hold, until interrupted")
    p.add_argument("--dump-json", metavar="DIR", help="write every relation as JSON lines")
    p.add_argument("--save-logs", metavar="DIR", help="write the logs as Parquet")
    p.add_argument("--disable-timeline", action="store_true")
    p.add_argument("--debug-replay-files", metavar="DIR", nargs="?", const="", help="show the first rows of each log, or write all of them as text to a folder")
    p.add_argument("--dataflow-profiling", action="store_true", help="keep Spark's event log of this analysis")
    p.add_argument("--completions", choices=SHELLS, help="print completions for a shell and end")
    p.add_argument("-q", "--quiet", action="store_true")
    return p


def completions(shell: str) -> str:
    """A script that completes the options in a shell."""
    options = [o for a in parser()._actions for o in a.option_strings if o.startswith("--")]
    words = " ".join(options)
    return {
        "bash": f"complete -W '{words}' tracemill",
        "zsh": f"#compdef tracemill\ncompadd -- {words}",
        "fish": "\n".join(f"complete -c tracemill -l {o[2:]}" for o in options),
        "powershell": "Register-ArgumentCompleter -Native -CommandName tracemill -ScriptBlock { param($word) "
        + ", ".join(f"'{o}'" for o in options) + " | Where-Object { $_ -like \"$word*\" } }",
        "elvish": f"set edit:completion:arg-completer[tracemill] = {{|@words| put {words} }}",
    }[shell]


def session(args: argparse.Namespace) -> SparkSession:
    builder = SparkSession.builder.appName("tracemill").config("spark.sql.session.timeZone", "UTC")
    if args.dataflow_profiling:
        folder = os.environ.get("TRACEMILL_EVENT_LOG", str(Path(args.output_dir).resolve() / "events"))
        Path(folder).mkdir(parents=True, exist_ok=True) if "://" not in folder else None
        builder = builder.config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", folder)
    spark = builder.getOrCreate()
    if os.environ.get("TRACEMILL_LOG"):
        spark.sparkContext.setLogLevel(os.environ["TRACEMILL_LOG"].upper())
    return spark


def _read(spark: SparkSession, args: argparse.Namespace) -> dict:
    kinds = ["timely", *["differential"] * args.differential, *["timely-progress"] * args.progress]
    if args.replay_logs:
        read = {k: logs.read_log(spark, args.replay_logs, k, args.stream_encoding or "parquet") for k in kinds}
    else:
        at = {"timely": args.address, "differential": args.differential_address, "timely-progress": args.progress_address}
        encoding = args.stream_encoding or "json"
        if encoding == "parquet":
            raise SystemExit("live logs are json or frames")
        folder = f"{checkpoint_dir(spark)}/tracemill/live-{uuid.uuid4().hex}"
        live.record({k: at[k] for k in kinds}, folder, args.connections, encoding, args.record_seconds)
        read = {k: logs.read_log(spark, [folder], k, encoding) for k in kinds}
    return {k: logs.shard(df, args.workers) for k, df in read.items()} if args.workers else read


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> Trace | None:
    args = parser().parse_args(argv)
    if args.completions:
        print(completions(args.completions))
        return None
    spark = spark or session(args)
    read = _read(spark, args)
    if args.debug_replay_files is not None:
        for kind, df in read.items():
            if args.debug_replay_files:
                sinks.dump_text(df, f"{args.debug_replay_files}/{kind}")
            else:
                df.show(20, truncate=False)
    if args.save_logs:
        for kind, df in read.items():
            sinks.save_log(df, args.save_logs, kind)
    trace = Trace(read["timely"], read.get("differential"), read.get("timely-progress"), disable_timeline=args.disable_timeline)
    if args.dump_json:
        for name, df in trace.all().items():
            sinks.dump_json(df, f"{args.dump_json}/{name}")
    if not args.no_report_file:
        Path(args.report_file).write_text(report.build(trace, args.differential))
    out = Path(args.output_dir)
    out.mkdir(parents=True, exist_ok=True)
    (out / "index.html").write_text(render.page(trace, args.palette, args.page_data or f"file://{out.resolve()}/data"))
    if not args.quiet:
        bold, plain = ("\x1b[1m", "\x1b[0m") if args.color == "always" or (args.color == "auto" and sys.stdout.isatty()) else ("", "")
        print(f"{bold}report:{plain} {args.report_file}, {bold}page:{plain} {out / 'index.html'}")
    while args.report_update_duration and args.replay_logs and not args.no_report_file:
        try:
            time.sleep(args.report_update_duration)
            read = _read(spark, args)
            trace = Trace(read["timely"], read.get("differential"), read.get("timely-progress"), disable_timeline=args.disable_timeline)
            Path(args.report_file).write_text(report.build(trace, args.differential))
        except KeyboardInterrupt:
            break
    return trace


if __name__ == "__main__":
    main()
