"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the folder of the tables, BENCH_CPUS the number of local cores. Every query runs
once to warm up; its figure is the median of the BENCH_RUNS runs after that. Results go to a sink that
drops them, so the figure holds planning and the whole of the work. Names that end in ``@60x`` run
three times at most, on 60 copies of the pages, a third of them on one host, where work outweighs
planning. The given pages are one file with one row group, which no scan can split, so they are copied
into a file per core first.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from webspark.plans.catalog import QUERIES

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
RUNS = int(os.environ.get("BENCH_RUNS", "5"))
HEADLINE = [
    "links_per_site",
    "extract_links",
    "canonicalize_url",
    "registered_domain",
    "resolve_reference",
    "import_links",
    "import_pages",
    "next_urls",
    "mark_queued",
    "robots_allowed",
    "apply_robots",
    "attach_address",
    "address_asof",
    "politeness_plan",
    "run_batches",
    "stream_extract",
    "stream_frontier",
]
LARGE = ["extract_links@60x", "links_per_site@60x", "robots_allowed@60x", "politeness_plan@60x"]
COPIES = 60


def session() -> SparkSession:
    folder = tempfile.mkdtemp(prefix="bench-")
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", f"{folder}/warehouse")
        .config("spark.checkpoint.dir", f"{folder}/shared")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def split(spark: SparkSession, folder: str) -> str:
    """A folder with the pages in a file per core."""
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet")
    pages.repartition(int(CPUS)).write.parquet(f"{folder}/pages.parquet")
    return folder


def enlarge(spark: SparkSession, folder: str) -> str:
    """A folder with the pages copied: other numbers and hosts, every third copy on one host."""
    host = "if(k % 3 = 0, 'hot.example.org', concat('c', k, '.', regexp_extract(url, '//([^/?#]*)', 1)))"
    (
        spark.read.parquet(f"{SF_DIR}/pages.parquet")
        .crossJoin(spark.range(COPIES).withColumnRenamed("id", "k"))
        .selectExpr(
            f"page_id * {COPIES} + k AS page_id",
            f"regexp_replace(url, '//[^/?#]*', concat('//', {host})) AS url",
            "html",
        )
        .repartition(32)
        .write.parquet(f"{folder}/pages.parquet")
    )
    return folder


def run(spark: SparkSession, name: str, small: str, large: str) -> float:
    query, _, copies = name.partition("@")
    start = time.perf_counter()
    QUERIES[query](spark, large if copies else small).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    spark = session()
    seconds = {}
    tables = (
        split(spark, tempfile.mkdtemp(prefix="bench-pages-")),
        enlarge(spark, tempfile.mkdtemp(prefix="bench-pages-")),
    )
    for name in sys.argv[1:] or [*HEADLINE, *LARGE]:
        run(spark, name, *tables)
        runs = min(RUNS, 3) if "@" in name else RUNS
        seconds[name] = round(statistics.median(run(spark, name, *tables) for _ in range(runs)), 4)
    line = {
        "metric": "total of the median times of the headline queries",
        "value": round(sum(seconds.values()), 4),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
    }
    spark.stop()
    print(json.dumps(line))


if __name__ == "__main__":
    main()
