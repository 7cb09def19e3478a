"""Raw table schemas and the quality rules declared on them.

Fixed values: table and column names (with the source's misspelt ``lenght``), the required,
timestamp and numeric column lists, and the accepted values.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql.types import StringType, StructField, StructType


@dataclass(frozen=True)
class RawTable:
    """One raw table: every column is text; the lists drive cleaning."""

    columns: tuple[str, ...]
    required: tuple[str, ...] = ()
    timestamps: tuple[str, ...] = ()
    numbers: tuple[str, ...] = ()
    line_breaks: bool = False  # texts people type: quoted fields may span lines

    @property
    def schema(self) -> StructType:
        return StructType([StructField(c, StringType()) for c in self.columns])


RAW_TABLES: dict[str, RawTable] = {
    "customers_dataset": RawTable(
        columns=(
            "customer_id",
            "customer_unique_id",
            "customer_zip_code_prefix",
            "customer_city",
            "customer_state",
        ),
        required=("customer_id", "customer_unique_id"),
    ),
    "sellers_dataset": RawTable(
        columns=("seller_id", "seller_zip_code_prefix", "seller_city", "seller_state"),
        required=("seller_id",),
    ),
    "products_dataset": RawTable(
        columns=(
            "product_id",
            "product_category_name",
            "product_name_lenght",
            "product_description_lenght",
            "product_photos_qty",
            "product_weight_g",
            "product_length_cm",
            "product_height_cm",
            "product_width_cm",
        ),
        required=("product_id",),
        numbers=(
            "product_weight_g",
            "product_length_cm",
            "product_height_cm",
            "product_width_cm",
            "product_photos_qty",
            "product_name_lenght",
            "product_description_lenght",
        ),
    ),
    "orders_dataset": RawTable(
        columns=(
            "order_id",
            "customer_id",
            "order_status",
            "order_purchase_timestamp",
            "order_approved_at",
            "order_delivered_carrier_date",
            "order_delivered_customer_date",
            "order_estimated_delivery_date",
        ),
        required=("order_id", "customer_id", "order_status", "order_purchase_timestamp"),
        timestamps=(
            "order_purchase_timestamp",
            "order_approved_at",
            "order_delivered_carrier_date",
            "order_delivered_customer_date",
            "order_estimated_delivery_date",
        ),
    ),
    "order_items_dataset": RawTable(
        columns=(
            "order_id",
            "order_item_id",
            "product_id",
            "seller_id",
            "shipping_limit_date",
            "price",
            "freight_value",
        ),
        required=("order_id", "product_id", "seller_id", "price"),
        timestamps=("shipping_limit_date",),
        numbers=("price", "freight_value", "order_item_id"),
    ),
    "order_payments_dataset": RawTable(
        columns=(
            "order_id",
            "payment_sequential",
            "payment_type",
            "payment_installments",
            "payment_value",
        ),
        required=("order_id", "payment_type", "payment_value"),
        numbers=("payment_value", "payment_installments", "payment_sequential"),
    ),
    "order_reviews_dataset": RawTable(
        columns=(
            "review_id",
            "order_id",
            "review_score",
            "review_comment_title",
            "review_comment_message",
            "review_creation_date",
            "review_answer_timestamp",
        ),
        required=("review_id", "order_id", "review_score"),
        timestamps=("review_creation_date", "review_answer_timestamp"),
        numbers=("review_score",),
        line_breaks=True,
    ),
    "geolocation_dataset": RawTable(
        columns=(
            "geolocation_zip_code_prefix",
            "geolocation_lat",
            "geolocation_lng",
            "geolocation_city",
            "geolocation_state",
        ),
        numbers=("geolocation_lat", "geolocation_lng"),
    ),
    "product_category_name_translation": RawTable(
        columns=("product_category_name", "product_category_name_english"),
    ),
}

ORDER_STATUSES = ("delivered", "shipped", "canceled", "processing", "invoiced", "approved")
PAYMENT_TYPES = ("credit_card", "boleto", "voucher", "debit_card")

# Declared constraints per staged frame: columns that must be unique, never null, or drawn
# from a fixed set.
UNIQUE = {
    "stg_orders": ("order_id",),
    "stg_customers": ("customer_id",),
    "stg_order_reviews": ("review_id",),
    "stg_products": ("product_id",),
    "stg_sellers": ("seller_id",),
}
NOT_NULL = {
    "stg_orders": ("order_id", "customer_id"),
    "stg_customers": ("customer_id",),
    "stg_order_items": ("order_id", "price"),
    "stg_order_payments": ("order_id",),
    "stg_order_reviews": ("review_id",),
    "stg_products": ("product_id",),
    "stg_sellers": ("seller_id",),
}
ACCEPTED = {
    "stg_orders": {"status": ORDER_STATUSES},
    "stg_order_payments": {"payment_type": PAYMENT_TYPES},
}
