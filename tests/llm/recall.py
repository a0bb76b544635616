"""How many pairs of different texts the n-gram Jaccard join finds, against a join of all shingles: ``python tests/llm/recall.py FOLDER``."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

SETS = r"""CREATE TABLE sets AS SELECT row_number() OVER () AS id, s FROM (SELECT DISTINCT list_sort(s) AS s FROM (
SELECT list_distinct(CASE WHEN len(w) < 5 THEN [hash(w)] ELSE list_transform(range(1, len(w) - 3), lambda i: hash(w[i:i + 4])) END) AS s
FROM (SELECT DISTINCT regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM read_parquet(?)) WHERE len(w) > 0))"""
PAIRS = """CREATE TABLE pairs AS WITH g AS (SELECT id, unnest(s) AS h FROM sets), n AS (SELECT id, len(s) AS n FROM sets),
c AS (SELECT a.id AS a, b.id AS b, count(*) AS m FROM g a JOIN g b ON a.h = b.h AND a.id < b.id GROUP BY ALL)
SELECT a, b, m / (x.n + y.n - m) AS j FROM c JOIN n x ON x.id = a JOIN n y ON y.id = b"""


def main(folder: str) -> None:
    import tempfile

    import duckdb
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from sluiceway.llm import ngram_join

    c = duckdb.connect()
    path = Path(f"{folder}/documents.parquet")
    c.execute(SETS, [str(path / "*.parquet") if path.is_dir() else str(path)])
    c.execute(PAIRS)
    bins = c.execute("SELECT count(*) FILTER (j >= 0.8), count(*) FILTER (j >= 0.6 AND j < 0.8), count(*) FILTER (j >= 0.3 AND j < 0.6) FROM pairs").fetchone()
    home = tempfile.mkdtemp(prefix="spark-")
    spark = SparkSession.builder.master("local[4]").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", f"file://{home}").getOrCreate()
    found = ngram_join.near_groups(spark.read.parquet(str(path))).where("set_id IS NOT NULL").groupBy("set_id").agg(F.first("n_text_links").alias("n")).agg(F.sum("n")).first()[0]
    print(f"pairs of different shingle sets at 0.8 or more: {bins[0]}, found: {(found or 0) // 2}; from 0.6 to 0.8: {bins[1]}, from 0.3 to 0.6: {bins[2]}")
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1])
