"""The whole warehouse as a graph of stored tables: each layer reads the one before."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplake.operators.aggregates import table_counts
from shoplake.operators.filters import exclude_types
from shoplake.plans import ads, dwd, dws
from shoplake.session import settings
from shoplake.sources.lake import load_table, write_partitioned

AT_ONCE = 6             # tables written at a time

# Disk: a table's shuffle files go as soon as it is written, not when the driver happens to
# collect its garbage, and tables and scratch copies are a third smaller than with snappy.
SAVING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
          "spark.sql.parquet.compression.codec": "zstd"}


@dataclass(frozen=True)
class Span:
    """The day scores are drawn for, the partition width of the fact tables, and first and
    last day of calendar and stock report; where not given, those of the stock log."""
    as_of: str
    grain: str = "day"
    start: str | None = None
    end: str | None = None


def build(spark: SparkSession, sources: Mapping[str, DataFrame], root: str, span: Span) -> dict[str, str]:
    """Build every layer under `root`; returns {table: path}. Re-running replaces tables.

    `sources` has dim_user, dim_product, fact_order, fact_order_item,
    fact_product_price_change and fact_stock_change. A table is written as soon as those it reads
    are there, several at a time, so the last tasks of one leave no cores idle. The session has
    the settings of SAVING meanwhile.
    """
    paths: dict[str, str] = {}
    tables: list[Future[DataFrame]] = []

    with settings(spark, SAVING), ThreadPoolExecutor(AT_ONCE) as pool:
        def store(name: str, make: Callable[..., DataFrame], *reads: Future[DataFrame], day: str | None = None,
                  after: Future[DataFrame] | None = None) -> Future[DataFrame]:
            path = paths[name] = f"{root}/{name.replace('.', '/')}"

            def written() -> DataFrame:
                # what it waits for was handed in before and is taken up first, so no table waits for one that cannot start
                if after:
                    after.result()
                df = make(*[table.result() for table in reads])
                if day:
                    write_partitioned(df, path, day, grain=span.grain)
                else:
                    load_table(df, path)
                return spark.read.parquet(path).drop("order_date") if day else spark.read.parquet(path)

            tables.append(pool.submit(inheritable_thread_target(spark)(written)))
            return tables[-1]

        ods = {name: store(f"ods.{name}", lambda df=df: df, day={"fact_order": "order_time",
                                                                 "fact_order_item": "create_time"}.get(name))
               for name, df in sources.items()}
        orders, lines, products, log = (ods[n] for n in ("fact_order", "fact_order_item", "dim_product", "fact_stock_change"))

        items = store("dwd.fact_order_item", dwd.fact_order_item, lines, products, day="create_time")
        acc = store("dwd.fact_order_acc", dwd.fact_order_acc, orders, day="order_time")
        users = store("dwd.dim_user", dwd.dim_user, ods["dim_user"], orders)
        store("dwd.dim_product", dwd.dim_product, products)

        days = log.result().agg(F.min(F.to_date("change_time")).cast("string"), F.max(F.to_date("change_time")).cast("string"))
        start, end = (given or seen for given, seen in zip((span.start, span.end), days.first(), strict=True))
        if not start or not end:
            raise ValueError("an empty stock log names no days; give the span's start and end")
        store("dwd.dim_date", lambda: dwd.dim_date(spark, start, end))
        store("dwd.dim_product_price_scd2", lambda prices, dim: dwd.dim_product_price_scd2(
            exclude_types(prices, ["FINAL"]), dim, start), ods["fact_product_price_change"], products)
        stock = store("dwd.fact_product_stock_per_day", lambda dim, changes: dwd.fact_product_stock_per_day(
            dim, changes, start, end), products, log)

        product_day = store("dws.trade_product_day", dws.trade_product_day, items)
        # one after the other, so that only one holds shuffle files of all lines
        category_day = store("dws.trade_category_day", dws.trade_category_day, items, after=product_day)
        user_day = store("dws.trade_user_day", dws.trade_user_day, acc)
        store("dws.trade_province_day", dws.trade_province_day, user_day, users)
        lifetime = store("dws.user_lifetime", dws.user_lifetime, acc)
        store("dws.product_stock_day", dws.product_stock_day, stock)

        store("ads.trade_overview_day", ads.trade_overview_day, user_day)
        store("ads.order_funnel_day", ads.order_funnel_day, user_day)
        store("ads.category_rank_day", ads.category_rank_day, category_day)
        store("ads.user_rfm", lambda spent: ads.user_rfm(spent, span.as_of), lifetime)
        store("ads.gmv_caliber_compare", ads.gmv_caliber_compare, product_day, user_day)
        store("ads.price_divergence_by_category", ads.price_divergence_by_category, category_day)
        for table in tables:
            table.result()
    return paths


def layer_sizes(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """Row count of every stored table."""
    return table_counts({name: spark.read.parquet(path) for name, path in paths.items()}) \
        .withColumn("layer", F.substring_index("table_name", ".", 1))
