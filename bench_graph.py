"""Times the three ways to find what depends on a task, over made-up graphs of tasks with a fan; prints one JSON line a graph.

walk: in the driver, as for any graph of at most graph.SMALL edges. loop: a join a level, as for larger ones. cte: recursive
SQL over paths, only where a path count of at most PATHS says that it ends.
"""

import json
import os
import sys
import time

HOME = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HOME)

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from lakeweave.operators import graph  # noqa: E402
from lakeweave.plans import lineage_graph  # noqa: E402

DEPTH, PATHS = 3, 200_000


def main() -> None:
    spark = SparkSession.builder.master(f"local[{os.environ.get('BENCH_CPUS', '8')}]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    for n in (100, 1_000, 10_000):
        for fan in (10, 50):
            each = spark.range(n).select(F.col("id").alias("dst"), F.explode(F.sequence(F.lit(1), F.lit(fan))).alias("k"))
            links = graph.cut(each.withColumn("src", F.floor((F.col("dst") - F.col("k")) / 2)).where("src >= 0 AND src < dst").selectExpr("CAST(src AS STRING) AS src", "CAST(dst AS STRING) AS dst").distinct())
            links.createOrReplaceTempView("bench_links")
            took = {"tasks": n, "fan": fan, "edges": links.count()}
            for way in ("walk", "loop"):
                for _ in range(2):  # the second run counts
                    began = time.time()
                    took[f"{way}_nodes"] = graph.blast_radius(links, "0", DEPTH, graph.SMALL if way == "walk" else 0).count()
                    took[f"{way}_s"] = round(time.time() - began, 3)
            held = links.toArrow()
            began = time.time()
            graph._walk_small(held, ["0"], DEPTH)
            took["walk_without_reading_s"] = round(time.time() - began, 4)
            if fan**DEPTH <= PATHS:
                began = time.time()
                took["cte_nodes"] = lineage_graph.downstream(links, "0", DEPTH).select("node_id").distinct().where("node_id <> '0'").count()
                took["cte_s"] = round(time.time() - began, 3)
            print(json.dumps(took), flush=True)


if __name__ == "__main__":
    main()
