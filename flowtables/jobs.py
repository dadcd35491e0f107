"""spark-submit entry points: python -m flowtables.jobs <job> ..."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from flowtables.plans.history import TrafficHistory, xml_to_json


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="flowtables.jobs")
    jobs = parser.add_subparsers(dest="job", required=True)

    convert = jobs.add_parser("xml-to-json", help="convert XML batch files to JSON batch documents")
    convert.add_argument("dataclass")
    convert.add_argument("source")
    convert.add_argument("target")

    upload = jobs.add_parser("upload", help="upsert batch files into the class table")
    upload.add_argument("root")
    upload.add_argument("authority")
    upload.add_argument("dataclass")
    upload.add_argument("source")
    upload.add_argument("--format", choices=["json", "xml"], default="json")
    upload.add_argument("--rejects", help="write records that could not be keyed here")

    flows = jobs.add_parser("time-range", help="merged detector flows of a time range, written as Parquet")
    flows.add_argument("root")
    flows.add_argument("authority")
    flows.add_argument("sdate")
    flows.add_argument("edate")
    flows.add_argument("target")
    flows.add_argument("--oid", nargs="*", default=None)
    for name in ("m_pce", "s_pce", "l_pce", "t_pce"):
        flows.add_argument(f"--{name}", type=float, default=1.0)
    for name, default in (("error_process", 0), ("null_time", 0), ("time_interval", 1), ("time_rolling", 1)):
        flows.add_argument(f"--{name}", type=int, default=default)

    options = vars(parser.parse_args(arguments))
    spark = SparkSession.builder.appName("flowtables").getOrCreate()
    job = options.pop("job")
    if job == "xml-to-json":
        xml_to_json(spark, options["dataclass"], options["source"], options["target"])
    elif job == "upload":
        history = TrafficHistory(spark, options["root"])
        load = history.upload_batch_xml if options["format"] == "xml" else history.upload_batch
        rejected = load(options["authority"], options["dataclass"], options["source"])
        if options["rejects"]:
            rejected.write.mode("overwrite").json(options["rejects"])
    else:
        history = TrafficHistory(spark, options.pop("root"))
        target = options.pop("target")
        rows = history.range_sum_lanes_sum_vehicles(
            options.pop("authority"), options.pop("oid"), options.pop("sdate"), options.pop("edate"), **options)
        rows.write.mode("overwrite").parquet(target)


if __name__ == "__main__":
    main()
