"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Conversions also report characters a second. Each query runs once to warm up and then REPEATS times; the best
counts. Results go to a sink that computes every row and keeps none.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"

REPEATS = int(os.environ.get("BENCH_REPEATS", "2"))
HEADLINE = ["convert_s2t", "convert_t2s_punct", "convert_t2tw", "convert_t2hkp", "convert_t2hkp_punct", "convert_hk2tp", "convert_t2jp", "zho_check", "normalize_compat_extended", "detofu_ext_b", "pipeline_norm_convert_detofu", "split_inclusive", "page_assembly", "page_pipeline", "office_convert"]


def main() -> None:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    import loomtext.queries as Q
    from loomtext.operators.convert import convert
    from loomtext.plans import corpus

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.files.maxPartitionBytes", "4m")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def timed(df_of) -> float:
        best = float("inf")
        for i in range(REPEATS + 1):
            t = time.perf_counter()
            df_of().write.format("noop").mode("overwrite").save()
            if i:
                best = min(best, time.perf_counter() - t)
        return best

    seconds = {name: round(timed(lambda n=name: Q.QUERIES[n](spark, sf_dir)), 3) for name in HEADLINE}
    rates = {}
    for name, config in (("phrases_t2hkp", "t2hkp"), ("phrases_t2tw", "t2tw"), ("characters_s2t", "s2t")):
        docs = corpus.phrase_corpus(spark, sf_dir, Q._keys(config)).unionByName(corpus.letter_corpus(spark, sf_dir)).repartition(int(cpus) * 2).cache()
        chars = docs.agg(F.sum(F.length("src"))).first()[0]
        rates[name] = round(chars / timed(lambda d=docs, c=config: d.select(convert("src", c).alias("o"))))
        docs.unpersist()
    print(json.dumps({"metric": "headline queries, seconds in all", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "chars_per_second": rates, "cpus": int(cpus), "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
