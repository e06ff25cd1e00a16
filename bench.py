"""Time the headline queries; prints one line of JSON."""

import json
import os
import time

from pyspark.sql import SparkSession

from verdant.plans import QUERIES

HEADLINE = ["b1_b2_vegetation_indices", "c2_nearest_date", "d1_d3_climate_normals", "d7_pixel_quantiles", "d12_theil_sen", "e1_find_peaks", "e6_j5_segments_trough", "e10_e11_smooth_reject", "e22_annual_phenology", "f3_f17_kf_smooth_band", "f4_f5_f11_multi_state"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    for name in HEADLINE[:2]:  # start-up of the JVM and its code is no query's own
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
    took = {}
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
