"""Binding of a star schema (orders, lineitem, customer, part, ...) to the canonical frames.

Two forms of the same mapping: ``Star`` gives typed staged frames directly; ``raw_tables`` gives
the all-text raw tables, blemished by fixed rules, that the staging and cleaning plans start from.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartwright.sources.schemas import RAW_TABLES

# Fixed values of the mapping.
STATUS = {"F": "delivered", "O": "shipped", "P": "processing"}
PAYMENT = {"A": "credit_card", "N": "boleto", "R": "voucher"}
TRANSLATION = {
    "economy": "budget_goods",
    "medium": "mid_range",
    "promo": "special_offers",
    "standard": "everyday_items",
}
AS_OF = "2001-08-02 00:00:00"
ESTIMATE_DAYS = 30


def _mapped(c: Column, mapping: dict[str, str]) -> Column:
    out = None
    for key, value in mapping.items():
        hit = c == F.lit(key)
        out = F.when(hit, F.lit(value)) if out is None else out.when(hit, F.lit(value))
    return out


def _after(start: Column, days=0, hours=0) -> Column:
    days = days if isinstance(days, Column) else F.lit(days)
    hours = hours if isinstance(hours, Column) else F.lit(hours)
    return start + F.make_dt_interval(days.cast("int"), hours.cast("int"))


def _text(c: str, name: str | None = None) -> Column:
    return F.col(c).cast("string").alias(name or c)


def _moment(c: str, name: str, missing: str = "") -> Column:
    return F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm:ss"), F.lit(missing)).alias(name)


class Star:
    """Typed canonical frames over the Parquet star tables in one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def orders(self) -> DataFrame:
        per_order = (
            self.table("lineitem")
            .groupBy("l_orderkey")
            .agg(F.sum("l_quantity").cast("bigint").alias("units"), F.count("*").alias("lines"))
        )
        o = self.table("orders").select(
            "o_orderkey",
            "o_custkey",
            _mapped(F.col("o_orderstatus"), STATUS).alias("status"),
            "o_orderdate",
            _after(F.col("o_orderdate"), hours=F.col("o_orderkey") % 24).alias("bought"),
        )
        status, bought = F.col("status"), F.col("bought")
        return o.join(per_order, o.o_orderkey == per_order.l_orderkey, "left").select(
            F.col("o_orderkey").alias("order_id"),
            F.col("o_custkey").alias("customer_id"),
            status,
            bought.alias("purchased_at"),
            F.when(status != "processing", _after(bought, hours=1)).alias("approved_at"),
            F.when(status != "processing", _after(bought, days=1)).alias("shipped_at"),
            F.when(
                status == "delivered",
                _after(bought, days=F.col("units") % 45, hours=F.col("lines") % 24),
            ).alias("delivered_at"),
            _after(F.col("o_orderdate"), days=ESTIMATE_DAYS).alias("estimated_delivery_at"),
        )

    @cached_property
    def customers(self) -> DataFrame:
        return (
            self.table("customer")
            .join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                F.col("c_custkey").alias("customer_id"),
                F.col("c_custkey").alias("unique_id"),
                F.col("r_name").alias("city"),
                F.col("n_name").alias("state"),
                F.lpad(F.col("n_nationkey").cast("string"), 5, "0").alias("zip_code"),
            )
        )

    @cached_property
    def sellers(self) -> DataFrame:
        return (
            self.table("supplier")
            .join(self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                F.col("s_suppkey").alias("seller_id"),
                F.col("r_name").alias("city"),
                F.col("n_name").alias("state"),
                F.lpad((F.col("n_nationkey") + 20).cast("string"), 5, "0").alias("zip_code"),
            )
        )

    def _products(self, category: Column) -> DataFrame:
        size = F.col("p_size").cast("string")
        return self.table("part").select(
            F.col("p_partkey").alias("product_id"),
            category.alias("category"),
            F.length("p_name").cast("string").alias("name_length"),
            F.length("p_type").cast("string").alias("description_length"),
            (F.col("p_size") % 6).cast("string").alias("photos_qty"),
            (F.col("p_size") * 100).cast("string").alias("weight_g"),
            size.alias("length_cm"),
            size.alias("height_cm"),
            size.alias("width_cm"),
        )

    @cached_property
    def products(self) -> DataFrame:
        kind = F.lower("p_type")
        return self._products(F.coalesce(_mapped(kind, TRANSLATION), kind))

    @cached_property
    def products_by_brand(self) -> DataFrame:
        """The same products with the brand as category: a wider set for recommendations."""
        return self._products(F.col("p_brand"))

    @cached_property
    def order_items(self) -> DataFrame:
        price = F.col("l_extendedprice").cast("decimal(10,2)")
        return (
            self.table("lineitem")
            .select(
                F.col("l_orderkey").alias("order_id"),
                F.col("l_linenumber").cast("string").alias("item_sequence"),
                F.col("l_partkey").alias("product_id"),
                F.col("l_suppkey").alias("seller_id"),
                F.col("l_shipdate").alias("shipping_limit_at"),
                price.alias("price"),
                (price * F.col("l_tax").cast("decimal(4,2)"))
                .cast("decimal(10,2)")
                .alias("freight_value"),
            )
            .withColumn("total_amount", F.col("price") + F.col("freight_value"))
        )

    @cached_property
    def order_payments(self) -> DataFrame:
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_linenumber").cast("string").alias("payment_sequence"),
            _mapped(F.col("l_returnflag"), PAYMENT).alias("payment_type"),
            F.col("l_quantity").cast("int").alias("installments"),
            F.col("l_extendedprice").cast("decimal(10,2)").alias("payment_value"),
        )

    @cached_property
    def order_reviews(self) -> DataFrame:
        score = (1 + F.col("l_quantity").cast("int") % 5).cast("int")
        return (
            self.table("lineitem")
            .filter(F.col("l_linenumber") == 1)
            .select(
                F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey").alias("review_id"),
                F.col("l_orderkey").alias("order_id"),
                score.alias("score"),
                F.col("l_linestatus").alias("comment"),
                _after(F.col("l_shipdate"), days=5).alias("reviewed_at"),
                _after(F.col("l_shipdate"), days=6).alias("answered_at"),
            )
            .withColumn("is_positive", F.coalesce(F.col("score") >= 4, F.lit(False)))
        )

    def raw(self, name: str) -> DataFrame:
        """One of the raw tables as text, with blemishes that depend only on the row.

        Padded status text, blank and ``None`` dates, repeated rows (returned items), missing
        customer keys (negative balances), numbers that are words (small quantities).
        """
        return getattr(self, f"_raw_{name}")()

    @property
    def raw_tables(self) -> dict[str, DataFrame]:
        return {name: self.raw(name) for name in RAW_TABLES}

    def _raw_customers_dataset(self) -> DataFrame:
        balance = self.table("customer").select(F.col("c_custkey").alias("customer_id"), "c_acctbal")
        return self.customers.join(balance, "customer_id").select(
            _text("customer_id"),
            F.when(F.col("c_acctbal") < 0, F.lit("nan"))
            .otherwise(F.col("unique_id").cast("string"))
            .alias("customer_unique_id"),
            F.col("zip_code").alias("customer_zip_code_prefix"),
            F.concat(F.lit("  "), "city").alias("customer_city"),
            F.concat("state", F.lit("\t")).alias("customer_state"),
        )

    def _raw_sellers_dataset(self) -> DataFrame:
        return self.sellers.select(
            _text("seller_id"),
            F.col("zip_code").alias("seller_zip_code_prefix"),
            F.col("city").alias("seller_city"),
            F.col("state").alias("seller_state"),
        )

    def _raw_products_dataset(self) -> DataFrame:
        return self.table("part").select(
            _text("p_partkey", "product_id"),
            F.lower("p_type").alias("product_category_name"),
            F.length("p_name").cast("string").alias("product_name_lenght"),
            F.length("p_type").cast("string").alias("product_description_lenght"),
            (F.col("p_size") % 6).cast("string").alias("product_photos_qty"),
            (F.col("p_size") * 100).cast("string").alias("product_weight_g"),
            _text("p_size", "product_length_cm"),
            _text("p_size", "product_height_cm"),
            _text("p_size", "product_width_cm"),
        )

    def _raw_orders_dataset(self) -> DataFrame:
        return self.orders.select(
            _text("order_id"),
            _text("customer_id"),
            F.concat(F.lit(" "), "status", F.lit(" ")).alias("order_status"),
            _moment("purchased_at", "order_purchase_timestamp"),
            _moment("approved_at", "order_approved_at", missing="None"),
            _moment("shipped_at", "order_delivered_carrier_date"),
            _moment("delivered_at", "order_delivered_customer_date"),
            _moment("estimated_delivery_at", "order_estimated_delivery_date"),
        )

    def _raw_order_items_dataset(self) -> DataFrame:
        price = F.col("l_extendedprice").cast("decimal(10,2)")
        freight = (price * F.col("l_tax").cast("decimal(4,2)")).cast("decimal(10,2)")
        # A returned line appears twice, the second time with a padded seller.
        sellers = F.when(
            F.col("l_returnflag") == "R", F.array(F.lit(""), F.lit(" "))
        ).otherwise(F.array(F.lit("")))
        return (
            self.table("lineitem")
            .withColumn("padding", F.explode(sellers))
            .select(
                _text("l_orderkey", "order_id"),
                _text("l_linenumber", "order_item_id"),
                _text("l_partkey", "product_id"),
                F.concat("padding", F.col("l_suppkey").cast("string")).alias("seller_id"),
                _moment("l_shipdate", "shipping_limit_date"),
                price.cast("string").alias("price"),
                F.when(F.col("l_quantity") <= 2, F.lit("unknown"))
                .otherwise(freight.cast("string"))
                .alias("freight_value"),
            )
        )

    def _raw_order_payments_dataset(self) -> DataFrame:
        return self.order_payments.select(
            _text("order_id"),
            F.col("payment_sequence").alias("payment_sequential"),
            "payment_type",
            _text("installments", "payment_installments"),
            _text("payment_value"),
        )

    def _raw_order_reviews_dataset(self) -> DataFrame:
        return self.order_reviews.select(
            "review_id",
            _text("order_id"),
            _text("score", "review_score"),
            F.lit("").alias("review_comment_title"),
            F.col("comment").alias("review_comment_message"),
            _moment("reviewed_at", "review_creation_date"),
            _moment("answered_at", "review_answer_timestamp"),
        )

    def _raw_geolocation_dataset(self) -> DataFrame:
        return self.table("nation").select(
            F.lpad(F.col("n_nationkey").cast("string"), 5, "0").alias("geolocation_zip_code_prefix"),
            _text("n_nationkey", "geolocation_lat"),
            F.when(F.col("n_regionkey") == 0, F.lit("east"))
            .otherwise(F.col("n_regionkey").cast("string"))
            .alias("geolocation_lng"),
            F.col("n_name").alias("geolocation_city"),
            F.col("n_name").alias("geolocation_state"),
        )

    def _raw_product_category_name_translation(self) -> DataFrame:
        """One row per product type that has a translation, read off the part table."""
        return (
            self.table("part")
            .select(F.lower("p_type").alias("product_category_name"))
            .distinct()
            .withColumn(
                "product_category_name_english",
                _mapped(F.col("product_category_name"), TRANSLATION),
            )
            .filter(F.col("product_category_name_english").isNotNull())
        )
