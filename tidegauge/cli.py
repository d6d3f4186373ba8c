"""Command line: ``list`` sensors, ``get`` their data, ``dump`` a tree or table file in another format."""

from __future__ import annotations

import argparse
import datetime as dt
import json
import sys
import time


def moment(text: str) -> float:
    """Seconds since 1970 of ``YYYY-MM-DDTHH:MM:SS`` (UTC), or of digits, taken as they are."""
    if text.lstrip("-").isdigit():
        return float(int(text))
    t = dt.datetime.fromisoformat(text.rstrip("Z"))
    return t.replace(tzinfo=dt.timezone.utc).timestamp()


def time_range(a: argparse.Namespace, now: float | None = None) -> tuple[float, float]:
    """(start, stop) of the options; the last ``length`` seconds (60) by default."""
    stop = a.to_ts if a.to_ts is not None else moment(a.to) if a.to else None
    start = a.from_ts if a.from_ts is not None else moment(a.from_) if a.from_ else None
    if stop is None:
        stop = start + a.length if start is not None and a.length else (time.time() if now is None else now)
    if start is None:
        start = stop - (a.length or 60)
    return float(start), float(stop)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidegauge", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("list", "get"):
        c = sub.add_parser(name)
        c.add_argument("sensor", nargs="*" if name == "list" else "+")
        c.add_argument("--config")
        c.add_argument("--data", help="parquet table of readings, or a jdbc: or postgresql: address")
        c.add_argument("--names", help="parquet table of names")
        c.add_argument("--basename", default="")
        c.add_argument("--version", type=int, default=1)
        c.add_argument("--date", type=int)
        c.add_argument("--delimiter")
        if name == "list":
            c.add_argument("--fields", default="number,name,label")
        else:
            c.add_argument("--from", dest="from_")
            c.add_argument("--to")
            c.add_argument("--from-ts", type=float)
            c.add_argument("--to-ts", type=float)
            c.add_argument("--length", type=float)
            c.add_argument("--interval", type=float)
            c.add_argument("--reducer", default="last")
            c.add_argument("--filler", default="none")
            c.add_argument("--summary", nargs="?", const="n,mean,std")
            c.add_argument("--series", action="store_true")
            c.add_argument("--json", action="store_true")
    c = sub.add_parser("dump")
    c.add_argument("file")
    c.add_argument("--to", default="json", choices=["json", "ktf", "yaml", "xml", "plist", "ini", "xpvp", "csv", "table", "c"])
    return p


def main(argv: list[str] | None = None, spark=None, out=None) -> int:
    from pyspark.sql import SparkSession

    from tidegauge.plans.app import App
    from tidegauge.sources import render
    from tidegauge.sources.tables import Source

    a = parser().parse_args(argv)
    out = out or sys.stdout
    say = lambda s: print(s, file=out)
    if a.command == "dump" and a.to == "c":
        from tidegauge.sources import trees

        say(trees.to_c(trees.text_of(a.file)).rstrip("\n"))
        return 0
    if a.command == "dump" and a.to not in ("csv", "table"):
        from tidegauge.sources import trees

        say(trees.WRITERS["." + a.to](trees.load_tree(a.file)).rstrip("\n"))
        return 0
    spark = spark or SparkSession.builder.appName("tidegauge").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command == "dump":
        from tidegauge.sources import tables

        say(tables.to_text(tables.read_table(spark, a.file).drop("segment"), ".csv" if a.to == "csv" else ".ktf").rstrip("\n"))
        return 0
    source = None
    if a.data:
        source = Source.jdbc(spark, a.data) if ":" in a.data.split("/")[0] else Source.parquet(spark, a.data, a.names)
    variables = {"version": a.version} | ({"date": a.date} if a.date else {})
    app = App(spark, source, a.config, variables=variables, base=[b for b in a.basename.split(".") if b], delimiters=a.delimiter)
    if a.command == "list":
        for s in app.find_like(*a.sensor):
            say(json.dumps(s.to_dict(a.fields.split(","), app.output_delimiter)))
        return 0
    start, stop = time_range(a)
    if a.summary:
        for r in app.summary(a.sensor, start, stop, a.summary.split(",")).orderBy("name").collect():
            say(json.dumps(r.asDict()))
    elif a.series and a.json:
        for r in render.series_json(app.read(a.sensor, start, stop), start, stop).orderBy("name").collect():
            say(json.dumps({r["name"]: json.loads(r["json"])}))
    elif a.series:
        for name, _ in app.resolve(a.sensor):
            say(f"DateTime,TimeStamp,{name}")
            for r in render.series_csv(app.read([name], start, stop), "x").orderBy("TimeStamp").toLocalIterator():
                say(f"{r[0]},{r[1]:.12g},{render.number(r[2])}")
    else:
        frame = app.frame(a.sensor, start, stop, a.interval, a.reducer, a.filler)
        say(render.frame_json(frame) if a.json else "\n".join(render.frame_lines(frame)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
