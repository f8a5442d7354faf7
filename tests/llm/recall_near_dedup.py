"""python -m tests.llm.recall_near_dedup SF_DIR: the share of all links that op7_near_dedup finds.

All pairs of different texts of a weighted Jaccard similarity of 0.8 or more come from SQL; a link is found if both of
its ends are in one class.
"""

import sys
import tempfile

import duckdb
from pyspark.sql import SparkSession

from bitloom.llm.oracles import NEAR_LINKS
from bitloom.llm.queries import op7_near_dedup


def main(sf_dir: str) -> None:
    db = duckdb.connect()
    db.execute(f"create view documents as select * from read_parquet('{sf_dir}/documents.parquet')")
    links = db.execute(f"with {NEAR_LINKS} select a, b from links").fetchall()
    shared = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark = SparkSession.builder.master("local[8]").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", "8").config("spark.checkpoint.dir", shared).getOrCreate()
    label = dict(op7_near_dedup(spark, sf_dir).select("doc_id", "class_id").collect())
    found = sum(label[a] == label[b] for a, b in links)
    print(f"{found} of {len(links)} links: recall {found / max(1, len(links)):.3f}")


if __name__ == "__main__":
    main(sys.argv[1])
