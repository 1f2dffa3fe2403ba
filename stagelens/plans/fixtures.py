"""The analysis entities expressed over the star-schema tables.

lineitem rows are tickets, orders are performances, nations are facilities, the
part type is the genre, part name / supplier / brand are cast / crew / organisation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stagelens.operators.graph import ROLES
from stagelens.session import clustered, tune

MONEY = "decimal(18,2)"
BROAD_GENRE = {
    "ECONOMY": "basic",
    "STANDARD": "basic",
    "PROMO": "light",
    "SMALL": "light",
    "MEDIUM": "heavy",
    "LARGE": "heavy",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def ticket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed transactions: one row per booking or cancellation."""
    line = table(spark, sf_dir, "lineitem")
    return line.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("ticket_no"),
        F.col("l_orderkey").alias("performance_id"),
        F.col("l_shipdate").alias("show_at"),
        F.when(F.col("l_returnflag") == "R", "cancel").otherwise("booking").alias("event_type"),
        F.col("l_quantity").cast("bigint").alias("quantity"),
        F.col("l_extendedprice").cast(MONEY).alias("amount"),
        "l_partkey", "l_suppkey", "l_linenumber",
        F.col("l_linestatus").alias("channel"),
        F.round(F.col("l_tax") * 100).cast("int").alias("payment"),
        F.round(F.col("l_discount") * 100).cast("int").alias("discount"),
    )


def performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    cust = F.col("o_custkey")
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_nationkey")
    return (
        orders.join(customer, "o_custkey")
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("o_orderkey").alias("performance_id"),
            F.col("c_name").alias("title"),
            F.col("n_name").alias("facility"),
            F.col("r_name").alias("region"),
            F.when(cust % 97 != 0, 8 + (cust * 37) % 1500).alias("seats"),
            (F.col("o_orderkey") % 14 - 1).alias("access_score"),
            F.when(F.col("o_orderstatus") == "P", "composite").otherwise("single").alias("kind"),
            F.year("o_orderdate").alias("yr"),
        )
    )


def line_genre(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genre mix of a performance with one ranking per measure; tickets with their genre are exchanged once, by performance."""
    t = ticket(spark, sf_dir).select("performance_id", "l_partkey", "amount", "quantity")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("genre"))
    mix = clustered(t.join(part, "l_partkey").drop("l_partkey"), ["performance_id"]).groupBy("performance_id", "genre").agg(
        F.sum("amount").cast("decimal(38,2)").alias("rev"), F.sum("quantity").alias("qty"), F.count("*").alias("cnt")
    )
    w = W.partitionBy("performance_id")
    return mix.withColumns(
        {f"rk_{m}": F.row_number().over(w.orderBy(F.col(m).desc(), "genre")) for m in ("rev", "qty", "cnt")}
    )


def label(mix: DataFrame) -> DataFrame:
    """Recorded genre (largest by amount) with its broad class, NULL for a genre without one."""
    broad = F.lit(None).cast("string")
    for genre, name in BROAD_GENRE.items():
        broad = F.when(F.col("genre") == genre, name).otherwise(broad)
    return mix.filter("rk_rev = 1").select("performance_id", F.col("genre").alias("mid"), broad.alias("broad"))


def prediction(mix: DataFrame) -> DataFrame:
    """Three runs of top-2 guesses, one per measure of the mix."""
    w = W.partitionBy("performance_id")
    shares = mix.select(
        "performance_id", "genre",
        *[F.struct(
            F.lit(run).alias("run_id"),
            F.col(f"rk_{m}").alias("rk"),
            F.round(F.col(m).cast("double") / F.sum(m).over(w).cast("double"), 6).alias("p"),
        ).alias(f"run{run}") for run, m in enumerate(("rev", "qty", "cnt"), 1)],
    )
    long = shares.select("performance_id", "genre", F.inline(F.array("run1", "run2", "run3"))).filter("rk <= 2")
    return long.groupBy("performance_id", "run_id").agg(
        *[F.max(F.when(F.col("rk") == i, F.col(c))).alias(n)
          for n, i, c in (("genre1", 1, "genre"), ("genre2", 2, "genre"), ("p1", 1, "p"), ("p2", 2, "p"))]
    )


def namings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences of names in the cells of a performance: (performance, name) and the times of each role.

    Named tickets are exchanged and grouped once, by performance.
    """
    t = ticket(spark, sf_dir).select("performance_id", "l_partkey", "l_suppkey")
    part = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"),
        F.inline(F.array(
            F.struct(F.lit("cast").alias("role"), F.col("p_name").alias("name")),
            F.struct(F.lit("org").alias("role"), F.col("p_brand").alias("name")),
        )),
    )
    supp = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("l_suppkey"), F.lit("crew").alias("role"), F.col("s_name").alias("name")
    )
    columns = ["performance_id", "role", "name"]
    named = t.join(part, "l_partkey").select(*columns).unionByName(t.join(supp, "l_suppkey").select(*columns))
    return clustered(named, ["performance_id"]).groupBy("performance_id", "name").agg(
        *[F.count_if(F.col("role") == role).alias(role) for role in ROLES])


# Parts that a performance prints beside an organisation, by line.
ORG_ROLES = ("host", "producer", "planner")


def named_cells(rows: DataFrame, spark: SparkSession, sf_dir: str, by: Sequence[str] = ()) -> DataFrame:
    """Add the raw multi-valued cells to rows with l_partkey, l_suppkey and org_role.

    ``by`` deals the rows out with their names, each once, before cells are made that repeat them.
    """
    part = table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "l_partkey")
    supp = table(spark, sf_dir, "supplier").withColumnRenamed("s_suppkey", "l_suppkey")
    named = rows.join(part, "l_partkey").join(supp, "l_suppkey").select(*rows.columns, "p_name", "p_type", "p_brand", "s_name")
    return (clustered(named, by) if by else named).select(
        *[c for c in rows.columns if c != "org_role"],
        F.concat("p_name", F.lit(" ("), "p_type", F.lit("), "), "s_name", F.lit(" 등")).alias("cast_txt"),
        F.concat("s_name", F.lit(",,"), "p_name", F.lit("외 ")).alias("crew_txt"),
        F.concat("p_brand", F.lit("("), "org_role", F.lit("), "), "s_name").alias("org_txt"),
    )


def org_role(line: str = "l_linenumber"):
    """Role of an organisation by the line number of the ticket."""
    return F.element_at(F.array(*[F.lit(x) for x in ORG_ROLES]), (F.col(line) % 3 + 1).cast("int"))


def ticket_cells(spark: SparkSession, sf_dir: str, by: Sequence[str] = ()) -> DataFrame:
    """Ticket rows with their raw multi-valued cells, as a flat export has them."""
    return named_cells(ticket(spark, sf_dir).withColumn("org_role", org_role()), spark, sf_dir, by)


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The different cells of each performance and the tickets that repeat them.

    Tickets are reduced to (event, part, supplier, role) before any name is looked up.
    """
    keys = ["performance_id", "l_partkey", "l_suppkey", "org_role"]
    few = ticket(spark, sf_dir).withColumn("org_role", org_role()).groupBy(*keys).agg(F.count("*").alias("tickets"))
    return named_cells(few, spark, sf_dir)
