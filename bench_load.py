"""Records per second of a dump load, on a dump made from the orders table.

Usage: bench_load.py [copies]; each copy adds one record per order.
"""

from __future__ import annotations

import gzip
import json
import os
import shutil
import sys
import tempfile
import time

from pyspark.sql import functions as F

from cratework.session import session
from cratework.sources import xml_dumps

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")

RECORD = """concat('<release id="', CAST(o_orderkey * {n} + copy AS STRING), '" status="Accepted">',
  '<artists><artist><id>', CAST(o_custkey AS STRING), '</id><name>Artist</name></artist></artists>',
  '<title>Release ', CAST(o_orderkey AS STRING), '</title><labels><label name="L" catno="C" id="5"/>',
  '</labels><extraartists><artist><id>9</id><name>P</name><role>Producer</role></artist></extraartists>',
  '<formats><format name="Vinyl" qty="1" text=""><descriptions><description>LP</description>',
  '</descriptions></format></formats><genres><genre>Rock</genre></genres><country>UK</country>',
  '<released>1999-03</released><master_id>', CAST(o_custkey AS STRING), '</master_id><tracklist>',
  repeat('<track><position>A1</position><title>Track</title><duration>3:05</duration></track>', 8),
  '</tracklist></release>') AS value"""


def main(copies: int) -> None:
    spark = session("bench-load", master=f"local[{os.environ.get('BENCH_CPUS', '8')}]",
                    spark__ui__enabled="false", spark__driver__memory="8g",
                    spark__sql__files__maxPartitionBytes="16m")
    spark.sparkContext.setLogLevel("ERROR")
    folder = tempfile.mkdtemp(prefix="run-")
    orders = spark.read.parquet(f"{FOLDER}/orders.parquet").repartition(8)
    numbered = orders.crossJoin(spark.range(copies).withColumnRenamed("id", "copy"))
    numbered.selectExpr(RECORD.format(n=copies)).write.text(f"{folder}/parts")
    path = f"{folder}/x_20250601_releases.xml"
    with open(path, "w", encoding="utf-8") as out:
        out.write("<releases>\n")
        for name in sorted(os.listdir(f"{folder}/parts")):
            if name.startswith("part-"):
                with open(f"{folder}/parts/{name}", encoding="utf-8") as part:
                    shutil.copyfileobj(part, out)
        out.write("</releases>\n")
    with open(path, "rb") as plain, gzip.open(f"{path}.gz", "wb", compresslevel=1) as packed:
        shutil.copyfileobj(plain, packed)
    result = {"megabytes": round(os.path.getsize(path) / 1e6, 1)}
    for label, file in (("plain", path), ("gzip", f"{path}.gz")):
        start = time.perf_counter()
        records = xml_dumps.read_records(spark, file, "releases")
        xml_dumps.accepted(records).write.mode("overwrite").parquet(f"{folder}/{label}")
        seconds = time.perf_counter() - start
        count = spark.read.parquet(f"{folder}/{label}").agg(F.count("*")).first()[0]
        result[label] = {"records": count, "seconds": round(seconds, 2),
                         "records_per_second": round(count / seconds)}
    print(json.dumps({"metric": "dump_load", **result}))
    spark.stop()


if __name__ == "__main__":
    main(int(sys.argv[1]) if len(sys.argv) > 1 else 2)
