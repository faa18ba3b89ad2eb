"""Command line: ``python -m tests.run_oracle [folder] [name ...]``."""

import sys
import time
import traceback

from pyspark.sql import SparkSession

import __spark_entry__ as entry
from tests.oracle import compare, connect


def main() -> None:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.warehouse.dir", "/tmp/tidemark-warehouse").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles = entry.queries(), entry.oracle_sql()
    con = connect(folder)
    bad = 0
    for name in sys.argv[2:] or queries:
        start = time.time()
        try:
            df = queries[name](spark, folder)
            problems = compare(df, con, oracles[name]) if name in oracles else [f"no oracle, {df.count()} rows"]
        except Exception:
            problems = [traceback.format_exc()[-1500:]]
        bad += bool(problems)
        print(f"{'ok ' if not problems else 'BAD'} {name} {time.time() - start:.2f}s", *problems, flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
