"""The driver's tables in the roles of genes, landscapes, families and species."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinfold.shared import bounded

#: Rows of a task where a table is dealt by a key, so that what a task sorts and counts does not grow with the table.
ROWS_A_TASK = 250_000
#: Lines of an order have no unique number; this order has no repeats.
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, key: str, source: DataFrame) -> DataFrame:
    """rows dealt by a key into as many parts as the rows of ``source`` ask for, which a file's footers tell."""
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-source.count() // ROWS_A_TASK))
    return rows.repartition(parts, key)


def order_landscapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(family, gene, landscape): orders as genes of their customer's family, part types of their lines as landscapes."""
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", *LINE_ORDER)
    parts = load(spark, sf_dir, "part").select("p_partkey", "p_type")
    typed = lines.join(parts, lines["l_partkey"] == parts["p_partkey"])
    scapes = typed.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(*LINE_ORDER, "p_type"))).alias("m"))
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return scapes.join(orders, scapes["l_orderkey"] == orders["o_orderkey"]).select(F.col("o_custkey").alias("family"), F.col("o_orderkey").alias("gene"), F.transform("m", lambda x: x["p_type"]).alias("landscape"))


def species_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, parent): root 1, regions at 2 + key, nations, the leaves, at 100 + key."""
    root = spark.range(1).select(F.lit(1).alias("node"), F.lit(None).cast("int").alias("parent"))
    regions = load(spark, sf_dir, "region").select((F.col("r_regionkey") + 2).alias("node"), F.lit(1).alias("parent"))
    nations = load(spark, sf_dir, "nation").select((F.col("n_nationkey") + 100).alias("node"), (F.col("n_regionkey") + 2).alias("parent"))
    return root.unionByName(regions).unionByName(nations)


def order_species(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(customer, family, species): a row a line; the order is the family, its supplier's nation the species.

    Rows lie by order, so what is counted by order moves no more.  They are dealt after they have met the suppliers: a
    shuffle by supplier, where these are too many to be sent along, would undo the dealing.
    """
    table = load(spark, sf_dir, "lineitem")
    suppliers = load(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_nationkey") + 100).alias("species"))
    lines = table.where("l_orderkey is not null").join(bounded(suppliers, suppliers.count()), table["l_suppkey"] == suppliers["s_suppkey"]).select("l_orderkey", "species")
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    joined = dealt(lines, "l_orderkey", table).join(orders, lines["l_orderkey"] == orders["o_orderkey"])
    return joined.select(F.col("o_custkey").alias("customer"), F.col("o_orderkey").alias("family"), "species")


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, user_id, ts, event_type, landscape): events of a user as genes along a genome."""
    from kinfold.operators.landscapes import windows

    events = load(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    return windows(events, ["user_id"], ["ts", "event_id"], "event_type")


def label_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(family, idx, gene, embedding): embeddings of a label as a family, numbered from 0."""
    rows = load(spark, sf_dir, "embeddings").select(F.col("label").alias("family"), F.col("vec_id").alias("gene"), "embedding")
    return rows.withColumn("idx", F.row_number().over(Window.partitionBy("family").orderBy("gene")) - 1)
