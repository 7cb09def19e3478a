"""Raw text tables to typed, renamed frames. Each is a narrow projection but ``products``."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwright.functions.text import as_int, as_money, as_timestamp


def orders(raw: DataFrame) -> DataFrame:
    return raw.select(
        "order_id",
        "customer_id",
        F.col("order_status").alias("status"),
        as_timestamp(F.col("order_purchase_timestamp")).alias("purchased_at"),
        as_timestamp(F.col("order_approved_at")).alias("approved_at"),
        as_timestamp(F.col("order_delivered_carrier_date")).alias("shipped_at"),
        as_timestamp(F.col("order_delivered_customer_date")).alias("delivered_at"),
        as_timestamp(F.col("order_estimated_delivery_date")).alias("estimated_delivery_at"),
    )


def customers(raw: DataFrame) -> DataFrame:
    return raw.select(
        "customer_id",
        F.col("customer_unique_id").alias("unique_id"),
        F.col("customer_city").alias("city"),
        F.col("customer_state").alias("state"),
        F.col("customer_zip_code_prefix").alias("zip_code"),
    )


def sellers(raw: DataFrame) -> DataFrame:
    return raw.select(
        "seller_id",
        F.col("seller_city").alias("city"),
        F.col("seller_state").alias("state"),
        F.col("seller_zip_code_prefix").alias("zip_code"),
    )


def products(raw: DataFrame, translation: DataFrame) -> DataFrame:
    """The translation table is small; its measured size decides whether it is broadcast."""
    english = translation.select(
        F.col("product_category_name").alias("original"),
        F.col("product_category_name_english").alias("english"),
    )
    return raw.join(english, F.col("product_category_name") == F.col("original"), "left").select(
        "product_id",
        F.coalesce("english", "product_category_name").alias("category"),
        F.col("product_name_lenght").alias("name_length"),
        F.col("product_description_lenght").alias("description_length"),
        F.col("product_photos_qty").alias("photos_qty"),
        F.col("product_weight_g").alias("weight_g"),
        F.col("product_length_cm").alias("length_cm"),
        F.col("product_height_cm").alias("height_cm"),
        F.col("product_width_cm").alias("width_cm"),
    )


def order_items(raw: DataFrame) -> DataFrame:
    return raw.select(
        "order_id",
        F.col("order_item_id").alias("item_sequence"),
        "product_id",
        "seller_id",
        as_timestamp(F.col("shipping_limit_date")).alias("shipping_limit_at"),
        as_money(F.col("price")).alias("price"),
        as_money(F.col("freight_value")).alias("freight_value"),
    ).withColumn("total_amount", F.col("price") + F.col("freight_value"))


def order_payments(raw: DataFrame) -> DataFrame:
    return raw.select(
        "order_id",
        F.col("payment_sequential").alias("payment_sequence"),
        "payment_type",
        as_int(F.col("payment_installments")).alias("installments"),
        as_money(F.col("payment_value")).alias("payment_value"),
    )


def order_reviews(raw: DataFrame) -> DataFrame:
    return raw.select(
        "review_id",
        "order_id",
        as_int(F.col("review_score")).alias("score"),
        F.col("review_comment_message").alias("comment"),
        as_timestamp(F.col("review_creation_date")).alias("reviewed_at"),
        as_timestamp(F.col("review_answer_timestamp")).alias("answered_at"),
    ).withColumn("is_positive", F.coalesce(F.col("score") >= 4, F.lit(False)))


def all_staged(raw: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """The seven staged frames from the raw tables, by name."""
    return {
        "stg_orders": orders(raw["orders_dataset"]),
        "stg_customers": customers(raw["customers_dataset"]),
        "stg_sellers": sellers(raw["sellers_dataset"]),
        "stg_products": products(
            raw["products_dataset"], raw["product_category_name_translation"]
        ),
        "stg_order_items": order_items(raw["order_items_dataset"]),
        "stg_order_payments": order_payments(raw["order_payments_dataset"]),
        "stg_order_reviews": order_reviews(raw["order_reviews_dataset"]),
    }
