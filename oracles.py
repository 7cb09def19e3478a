"""The same results as plain SQL for a single-node engine, from the same star tables.

``CTES`` holds one named query per frame; ``sql(text)`` puts the ones a query needs in front of it.
"""

from __future__ import annotations

import re

# A 128-bit digest modulo 10000, folded from its four 32-bit parts (2**32 mod 10000 = 7296).
_EMBEDDING = """list_transform(
            list_transform(range(64), lambda i: md5(text || cast(i as varchar))),
            lambda h: cast(list_reduce(
                list_transform([1, 9, 17, 25],
                               lambda p: cast('0x' || substr(h, p, 8) as bigint)),
                lambda acc, part: (acc * 7296 + part % 10000) % 10000, cast(0 as bigint)) as double)
                / 10000.0)"""

FEATURES = (
    "recency_days total_orders total_items total_revenue avg_order_value max_order_value "
    "orders_per_month avg_review_score positive_review_rate avg_delivery_days on_time_rate "
    "recency_score frequency_score monetary_score"
).split()

CTES: dict[str, str] = {
    # ---- canonical frames bound to the star tables -------------------------------------------
    "stg_orders": """
        select o_orderkey as order_id, o_custkey as customer_id, status,
               bought as purchased_at,
               case when status <> 'processing' then bought + to_hours(1) end as approved_at,
               case when status <> 'processing' then bought + to_days(1) end as shipped_at,
               case when status = 'delivered'
                    then bought + to_days(cast(units % 45 as integer)) + to_hours(lines % 24)
               end as delivered_at,
               o_orderdate + to_days(30) as estimated_delivery_at
        from (
            select o.*, case o_orderstatus when 'F' then 'delivered' when 'O' then 'shipped'
                                           when 'P' then 'processing' end as status,
                   o_orderdate + to_hours(o_orderkey % 24) as bought
            from orders o
        ) o
        left join (
            select l_orderkey, cast(sum(l_quantity) as bigint) as units, count(*) as lines
            from lineitem group by l_orderkey
        ) l on o_orderkey = l_orderkey""",
    "stg_customers": """
        select c_custkey as customer_id, c_custkey as unique_id, r_name as city,
               n_name as state, lpad(cast(n_nationkey as varchar), 5, '0') as zip_code
        from customer join nation on c_nationkey = n_nationkey
        join region on n_regionkey = r_regionkey""",
    "stg_sellers": """
        select s_suppkey as seller_id, r_name as city, n_name as state,
               lpad(cast(n_nationkey + 20 as varchar), 5, '0') as zip_code
        from supplier join nation on s_nationkey = n_nationkey
        join region on n_regionkey = r_regionkey""",
    "stg_products": """
        select p_partkey as product_id,
               case lower(p_type) when 'economy' then 'budget_goods' when 'medium' then 'mid_range'
                    when 'promo' then 'special_offers' when 'standard' then 'everyday_items'
                    else lower(p_type) end as category,
               p_brand as brand,
               cast(length(p_name) as varchar) as name_length,
               cast(length(p_type) as varchar) as description_length,
               cast(p_size % 6 as varchar) as photos_qty,
               cast(p_size * 100 as varchar) as weight_g,
               cast(p_size as varchar) as length_cm, cast(p_size as varchar) as height_cm,
               cast(p_size as varchar) as width_cm
        from part""",
    "stg_order_items": """
        select *, price + freight_value as total_amount from (
            select l_orderkey as order_id, cast(l_linenumber as varchar) as item_sequence,
                   l_partkey as product_id, l_suppkey as seller_id,
                   l_shipdate as shipping_limit_at,
                   cast(l_extendedprice as decimal(10,2)) as price,
                   cast(cast(l_extendedprice as decimal(10,2)) * cast(l_tax as decimal(4,2))
                        as decimal(10,2)) as freight_value,
                   l_returnflag, l_quantity
            from lineitem)""",
    "stg_order_payments": """
        select l_orderkey as order_id, cast(l_linenumber as varchar) as payment_sequence,
               case l_returnflag when 'A' then 'credit_card' when 'N' then 'boleto'
                                 when 'R' then 'voucher' end as payment_type,
               cast(l_quantity as integer) as installments,
               cast(l_extendedprice as decimal(10,2)) as payment_value
        from lineitem""",
    "stg_order_reviews": """
        select concat_ws('-', l_orderkey, l_partkey, l_suppkey) as review_id,
               l_orderkey as order_id,
               cast(1 + cast(l_quantity as integer) % 5 as integer) as score,
               l_linestatus as comment,
               l_shipdate + to_days(5) as reviewed_at, l_shipdate + to_days(6) as answered_at,
               1 + cast(l_quantity as integer) % 5 >= 4 as is_positive
        from lineitem where l_linenumber = 1""",
    "clean_orders": """
        select * replace (cast(order_id as varchar) as order_id,
                          cast(customer_id as varchar) as customer_id) from stg_orders""",
    "clean_customers": """
        select * replace (cast(customer_id as varchar) as customer_id,
                          cast(unique_id as varchar) as unique_id)
        from stg_customers
        where customer_id in (select c_custkey from customer where c_acctbal >= 0)""",
    "clean_items": """
        select *, price + freight_value as total_amount from (
            select distinct cast(order_id as varchar) as order_id, item_sequence,
                   cast(product_id as varchar) as product_id,
                   cast(seller_id as varchar) as seller_id, shipping_limit_at, price,
                   case when l_quantity > 2 then freight_value end as freight_value
            from stg_order_items)""",
    "clean_payments": """
        select distinct * replace (cast(order_id as varchar) as order_id)
        from stg_order_payments""",
    "clean_reviews": """
        select distinct * replace (cast(order_id as varchar) as order_id)
        from stg_order_reviews""",
    "translated": """
        select distinct lower(p_type) from part
        where lower(p_type) in ('economy', 'medium', 'promo', 'standard')""",
    # ---- intermediate frames -----------------------------------------------------------------
    "payment_totals": """
        select order_id, sum(payment_value) as total_payment, max(installments) as max_installments,
               count(payment_sequence) as payment_count,
               arg_max(payment_type, row(payment_value, payment_type)) as primary_payment_type
        from stg_order_payments group by order_id""",
    "item_totals": """
        select order_id, count(*) as item_count, sum(total_amount) as order_value
        from stg_order_items group by order_id""",
    "int_orders": """
        select o.*, c.unique_id as customer_unique_id, c.city as customer_city,
               c.state as customer_state, p.total_payment, p.max_installments, p.payment_count,
               p.primary_payment_type,
               datesub('day', o.purchased_at, o.delivered_at) as delivery_days,
               datesub('day', o.estimated_delivery_at, o.delivered_at) as delivery_delay_days,
               coalesce(o.delivered_at <= o.estimated_delivery_at, false) as delivered_on_time
        from stg_orders o left join stg_customers c using (customer_id)
        left join payment_totals p using (order_id)""",
    "int_items": """
        select i.*, p.category as product_category, p.brand as product_brand,
               p.weight_g as product_weight_g, p.photos_qty as product_photos_qty,
               s.city as seller_city, s.state as seller_state,
               round(cast(i.freight_value as double) / nullif(cast(i.total_amount as double), 0)
                     * 100, 2) as freight_pct
        from stg_order_items i left join stg_products p using (product_id)
        left join stg_sellers s using (seller_id)""",
    "fct": """
        select o.*, i.item_count, i.order_value,
               cast(year(o.purchased_at) as integer) as purchase_year,
               cast(month(o.purchased_at) as integer) as purchase_month,
               cast(isodow(o.purchased_at) as integer) as purchase_dow,
               r.score as review_score, r.is_positive as is_positive_review, r.order_id as reviewed
        from int_orders o left join item_totals i using (order_id)
        left join stg_order_reviews r on o.order_id = r.order_id""",
    "rollup": """
        select customer_unique_id, customer_city, customer_state,
               count(order_id) as total_orders, cast(sum(item_count) as bigint) as total_items,
               sum(order_value) as total_revenue,
               cast(sum(order_value) as double) / count(order_value) as avg_order_value,
               min(order_value) as min_order_value, max(order_value) as max_order_value,
               min(purchased_at) as first_order_at, max(purchased_at) as last_order_at,
               datesub('day', min(purchased_at), max(purchased_at)) as customer_age_days,
               datesub('day', max(purchased_at), timestamp '2001-08-02 00:00:00') as recency_days,
               cast(sum(delivery_days) as double) / count(delivery_days) as avg_delivery_days,
               cast(sum(case when delivered_on_time then 1 else 0 end) as bigint)
                   as on_time_deliveries,
               cast(sum(review_score) as double) / nullif(count(review_score), 0)
                   as avg_review_score,
               cast(sum(case when is_positive_review then 1 else 0 end) as bigint)
                   as positive_reviews,
               count(reviewed) as total_reviews
        from fct where status = 'delivered'
        group by customer_unique_id, customer_city, customer_state""",
    "dim": """
        select *, case when recency_score >= 4 and frequency_score >= 4 then 'Champion'
                       when recency_score >= 3 and frequency_score >= 3 then 'Loyal'
                       when recency_score >= 4 and frequency_score <= 2 then 'New Customer'
                       when recency_score <= 2 and frequency_score >= 3 then 'At Risk'
                       when recency_score <= 2 and frequency_score <= 2 then 'Lost'
                       else 'Potential' end as customer_segment
        from (
            select *,
                ntile(5) over (order by recency_days desc nulls last, customer_unique_id,
                               customer_city, customer_state) as recency_score,
                ntile(5) over (order by total_orders asc nulls last, customer_unique_id,
                               customer_city, customer_state) as frequency_score,
                ntile(5) over (order by total_revenue asc nulls last, customer_unique_id,
                               customer_city, customer_state) as monetary_score
            from rollup)""",
    "metrics": """
        select customer_unique_id, recency_days, recency_score,
               cast(case when recency_days <= 90 then 1 else 0 end as integer) as active_last_90d,
               cast(case when recency_days <= 180 then 1 else 0 end as integer) as active_last_180d,
               total_orders, frequency_score, total_items,
               round(cast(total_orders * 30 as double) / nullif(customer_age_days, 0), 4)
                   as orders_per_month,
               total_revenue, monetary_score, avg_order_value, max_order_value, avg_review_score,
               total_reviews,
               round(cast(positive_reviews as double) / nullif(total_reviews, 0), 4)
                   as positive_review_rate,
               avg_delivery_days,
               round(cast(on_time_deliveries as double) / nullif(total_orders, 0), 4)
                   as on_time_rate,
               customer_state, customer_segment,
               cast(case when total_orders = 1 then 1 else 0 end as integer) as is_churned
        from dim""",
    # ---- cohorts -----------------------------------------------------------------------------
    "activity": """
        select cohort_month, period, count(distinct customer_unique_id) as customers
        from (
            select f.customer_unique_id, c.cohort_month,
                   cast((year(f.purchased_at) - year(c.cohort_month)) * 12
                        + month(f.purchased_at) - month(c.cohort_month) as integer) as period
            from fct f join (
                select customer_unique_id,
                       cast(date_trunc('month', min(purchased_at)) as date) as cohort_month
                from fct where status = 'delivered' group by customer_unique_id
            ) c on f.customer_unique_id = c.customer_unique_id
            where f.status = 'delivered')
        group by cohort_month, period""",
    "rates": """
        select a.cohort_month, strftime(a.cohort_month, '%Y-%m') as cohort, a.period,
               round(round(a.customers / cast(z.customers as double), 4) * 100, 2) as retention_pct
        from activity a join activity z on a.cohort_month = z.cohort_month and z.period = 0""",
    # ---- retrieval -----------------------------------------------------------------------------
    "document_vectors": f"select doc_id as id, text, {_EMBEDDING} as vec from documents",
    "question_vectors": f"select item_id as id, {_EMBEDDING} as vec from benchmark",
    "question_top": """
        select *, row_number() over (partition by question_id
                                     order by round(cosine, 10) desc, document_id) as place
        from (select q.id as question_id, d.id as document_id, d.text,
                     list_cosine_similarity(q.vec, d.vec) as cosine
              from question_vectors q cross join document_vectors d)
        qualify place <= 3""",
    # ---- features ------------------------------------------------------------------------------
    "churn_frame": f"""
        select customer_unique_id,
               {', '.join(f'cast({c} as double) as {c}' for c in FEATURES)},
               customer_state, is_churned from metrics""",
    "marked": """
        select customer_unique_id, is_churned, md5(cast(customer_unique_id as varchar) || '#42') as d,
               row_number() over (partition by is_churned order by d) as rn,
               count(*) over (partition by is_churned) as n
        from metrics""",
    # ---- recommender ---------------------------------------------------------------------------
    "purchases": """
        select f.customer_unique_id, i.product_brand as product_category,
               count(*) as purchase_count, sum(i.total_amount) as total_spent
        from int_items i join fct f on i.order_id = f.order_id
        where f.status = 'delivered' and i.product_brand is not null
        group by f.customer_unique_id, i.product_brand""",
    "norms": """
        select customer_unique_id as id, cast(sum(purchase_count * purchase_count) as double) as nn
        from purchases group by customer_unique_id""",
    "dots": """
        select a.customer_unique_id as x, b.customer_unique_id as y,
               cast(sum(a.purchase_count * b.purchase_count) as double) as dot
        from purchases a join purchases b on a.product_category = b.product_category
        group by 1, 2""",
    "neighbours": """
        select *, row_number() over (partition by x order by similarity desc, y) as place
        from (select a.id as x, b.id as y,
                     round(coalesce(d.dot, 0) / sqrt(a.nn * b.nn), 10) as similarity
              from norms a join norms b on a.id <> b.id
              left join dots d on d.x = a.id and d.y = b.id)
        qualify place <= 10""",
    "recs": """
        select *, row_number() over (partition by customer_unique_id
                                     order by score desc, category) as place
        from (
            select n.id as customer_unique_id, c.category,
                   cast(coalesce(w.score, 0) as double) as score
            from norms n cross join (select distinct product_category as category from purchases) c
            left join (
                select x, product_category,
                       sum(cast(similarity as decimal(12,10))
                           * cast(purchase_count as decimal(20,0))) as score
                from neighbours join purchases on y = customer_unique_id
                group by x, product_category
            ) w on w.x = n.id and w.product_category = c.category
            where not exists (select 1 from purchases b where b.customer_unique_id = n.id
                              and b.product_category = c.category))
        qualify place <= 3""",
    "histogram": """
        select delivery_days, count(*) as orders from fct
        where status = 'delivered' and delivery_days between 1 and 60 group by delivery_days""",
}


def _rounds(text: str) -> str:
    """Spell out ``round(x, n)``: half up, once, where a double within two units in its last
    place of a half counts as that half. DuckDB's own rounds the binary product instead."""
    out, at = [], 0
    for found in re.finditer(r"\bround\(", text):
        if found.start() < at:
            continue
        depth, end, comma = 1, found.end(), 0
        while depth:
            char = text[end]
            depth += (char == "(") - (char == ")")
            if char == "," and depth == 1:
                comma = end
            end += 1
        digits = text[comma + 1 : end - 1].strip()
        inner = _rounds(text[found.end() : comma])
        out.append(text[at : found.start()])
        if digits == "10":
            out.append(f"round({inner}, 10)")
        else:
            unit = f"1e{digits}"
            out.append(
                f"list_transform([cast({inner} as double)], lambda v: sign(v) * (floor("
                f"abs(v) * {unit} * (1 + pow(2, -50)) + 0.5) / {unit}) + 0.0)[1]"
            )
        at = end
    return "".join(out) + text[at:]


def sql(text: str) -> str:
    """Prefix a query with the named frames it uses, in dependency order."""
    needed: list[str] = []

    def visit(body: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b(?:from|join)\s+{name}\b", body):
                visit(CTES[name])
                if name not in needed:
                    needed.append(name)

    visit(text)
    if text.startswith("with_total"):
        text = ", " + text
    if needed and text.lstrip().startswith("with "):  # the query's own frames follow
        text = ", " + text.lstrip().removeprefix("with ")
    if needed:
        text = "with " + ",\n".join(f"{n} as ({CTES[n]})" for n in needed) + "\n" + text
    return _rounds(text)


def _money(column: str) -> str:
    return f"cast(round({column}, 2) as double)"


def _avg(column: str, digits: int = 2) -> str:
    return f"round(cast(sum({column}) as double) / nullif(count({column}), 0), {digits})"


def _report(
    table: str, before: str, after: str, rows: str = "count(*)", dropped: str = "max(0)",
    blanks: str = "max(0)", invalid: str = "max(0)",
) -> str:
    """Lines of the quality report; issue counts other than drops are taken after cleaning."""
    n, kept = f"(select {rows} from {before})", f"(select count(*) from {after})"
    lost = f"(select {dropped} from {before})"
    counts = {
        "rows before": n,
        "duplicate rows removed": f"{n} - {kept} - {lost}"
        if before != after else "0",
        "null required rows dropped": lost,
        "empty timestamps fixed": f"(select {blanks} from {after})",
        "invalid numeric values": f"(select {invalid} from {after})",
        "rows after": f"{kept} - {lost}" if before == after else kept,
    }
    lines = [
        f"select '{table}' as \"table\", '{m}' as measure, cast({c} as bigint) as count"
        for m, c in counts.items()
    ]
    return " union all ".join(lines)


def _with_total(reports: str) -> str:
    return (
        f"with_total as (select * from ({reports}))\n"
        "select * from with_total union all select 'all tables', 'total issues fixed', "
        "cast(sum(count) as bigint) from with_total where measure not in ('rows before', "
        "'rows after')"
    )


def _violations(model: str, column: str, rule: str, count: str) -> str:
    return (
        f"select '{model}' as model, '{column}' as column_name, '{rule}' as rule, "
        f"({count}) as failures"
    )


def _unique(model: str, frame: str, column: str) -> str:
    repeats = f"select {column} from {frame} group by {column} having count(*) > 1"
    return _violations(model, column, "unique", f"select count(*) from ({repeats})")


def _not_null(model: str, frame: str, column: str) -> str:
    return _violations(
        model, column, "not_null", f"select count(*) from {frame} where {column} is null"
    )


def _accepted(model: str, frame: str, column: str, values: str) -> str:
    listed = ", ".join(f"'{v}'" for v in values.split())
    return _violations(
        model, column, "accepted_values",
        f"select count(distinct {column}) from {frame} where {column} not in ({listed})",
    )


def _two(column: str) -> str:
    return f"cast(cast({column} as decimal(38,2)) as varchar)"


FCT_COLUMNS = """order_id, customer_id, customer_unique_id, status, primary_payment_type,
    max_installments, item_count, cast(order_value as double) as order_value,
    cast(total_payment as double) as total_payment, purchased_at, approved_at, shipped_at,
    delivered_at, estimated_delivery_at, purchase_year, purchase_month, purchase_dow,
    delivery_days, delivery_delay_days, delivered_on_time, customer_city, customer_state,
    review_score, is_positive_review"""

ROLLUP_COLUMNS = """customer_unique_id, customer_city, customer_state, total_orders, total_items,
    cast(total_revenue as double) as total_revenue, avg_order_value,
    cast(min_order_value as double) as min_order_value,
    cast(max_order_value as double) as max_order_value, first_order_at, last_order_at,
    customer_age_days, recency_days, avg_delivery_days, on_time_deliveries, avg_review_score,
    positive_reviews, total_reviews"""

QUERIES: dict[str, str] = {
    "kpi_overview": f"""
        select count(distinct order_id) as total_orders,
               count(distinct customer_unique_id) as total_customers,
               {_money('sum(order_value)')} as total_revenue,
               {_avg('order_value')} as avg_order_value,
               {_avg('review_score')} as avg_review_score,
               round(sum(case when delivered_on_time then 1 else 0 end) * 100.0::double / count(*), 2)
                   as on_time_pct
        from fct where status = 'delivered'""",
    "orders_by_status": "select status, count(*) as order_count from fct group by status",
    "fct_orders": f"select {FCT_COLUMNS} from fct",
    "revenue_by_month": f"""
        select cast(purchase_year as varchar) || '-'
                   || lpad(cast(purchase_month as varchar), 2, '0') as period,
               {_money('sum(order_value)')} as revenue, count(distinct order_id) as orders,
               count(*) as fact_rows
        from fct where status = 'delivered' group by purchase_year, purchase_month""",
    "top_categories": f"""
        select product_category, count(distinct order_id) as orders,
               {_money('sum(total_amount)')} as revenue
        from int_items group by product_category
        order by revenue desc nulls last, product_category limit 10""",
    "revenue_by_state": f"""
        select customer_state, count(distinct order_id) as orders,
               {_money('sum(order_value)')} as revenue
        from fct where status = 'delivered' group by customer_state""",
    "top_states_by_orders": f"""
        select customer_state, count(distinct order_id) as orders,
               {_money('sum(order_value)')} as revenue
        from fct where status = 'delivered' group by customer_state
        order by orders desc, customer_state limit 10""",
    "state_labels": f"""
        select customer_state, revenue, '$' || format('{{:,}}', cast(round_even(revenue, 0) as bigint)) as label
        from (select customer_state, {_money('sum(order_value)')} as revenue
              from fct where status = 'delivered' group by customer_state
              order by revenue desc, customer_state limit 10)""",
    "orders_enriched": """
        select order_id, customer_id, status, purchased_at, approved_at, shipped_at, delivered_at,
               estimated_delivery_at, customer_unique_id, customer_city, customer_state,
               cast(total_payment as double) as total_payment, max_installments, payment_count,
               primary_payment_type, delivery_days, delivery_delay_days, delivered_on_time
        from int_orders""",
    "order_items_enriched": """
        select order_id, item_sequence, product_id, seller_id, cast(price as double) as price,
               cast(freight_value as double) as freight_value,
               cast(total_amount as double) as total_amount, shipping_limit_at, product_category,
               product_weight_g, product_photos_qty, seller_city, seller_state, freight_pct
        from int_items""",
    "customer_rollup": f"select {ROLLUP_COLUMNS} from rollup",
    "rfm_scores": """
        select customer_unique_id, recency_days, total_orders,
               cast(total_revenue as double) as total_revenue, recency_score, frequency_score,
               monetary_score, customer_segment, customer_state from dim""",
    "dim_customers": f"""
        select {ROLLUP_COLUMNS}, recency_score, frequency_score, monetary_score, customer_segment
        from dim""",
    "segment_summary": f"""
        select customer_segment, count(*) as customers, count(customer_unique_id) as identified,
               {_avg('total_revenue')} as avg_revenue, round(avg(total_orders), 2) as avg_orders,
               round(avg(recency_days), 2) as avg_recency,
               round(avg(avg_review_score), 2) as avg_score
        from dim group by customer_segment""",
    "segment_share": f"""
        select customer_segment, customers, mean_revenue,
               round(customers * 100 / cast(sum(customers) over () as double), 1) as share_pct
        from (select customer_segment, count(*) as customers, {_avg('total_revenue')} as mean_revenue
              from dim group by customer_segment)""",
    "segment_points": """
        select customer_unique_id, customer_segment, recency_days,
               cast(total_revenue as double) as total_revenue from dim""",
    "distinct_segments": "select distinct customer_segment from dim",
    "customer_metrics": """
        select * replace (cast(total_revenue as double) as total_revenue,
                          cast(max_order_value as double) as max_order_value) from metrics""",
    "churn_summary": f"""
        select is_churned,
               case when is_churned = 1 then 'At Risk (1 order)' else 'Active (2+ orders)' end
                   as label,
               count(*) as customers, {_avg('total_revenue')} as avg_revenue,
               round(avg(total_orders), 2) as avg_orders, round(avg(recency_days), 0) as avg_recency
        from metrics group by is_churned""",
    "churn_table": f"""
        select case when is_churned = 1 then 'At Risk (1 order)' else 'Active (2+ orders)' end
                   as "Segment",
               count(*) as "Customers", {_avg('total_revenue')} as "Avg Revenue ($)",
               round(avg(total_orders), 2) as "Avg Orders",
               round(avg(recency_days), 0) as "Avg Recency (days)"
        from metrics group by is_churned""",
    "clv_by_segment": f"""
        select customer_segment, {_avg('total_revenue')} as avg_clv,
               {_money('min(total_revenue)')} as min_clv, {_money('max(total_revenue)')} as max_clv,
               count(*) as customers
        from metrics group by customer_segment""",
    "clv_table": f"""
        select customer_segment as "Segment", count(*) as "Customers",
               {_avg('total_revenue')} as "Avg CLV ($)",
               {_money('min(total_revenue)')} as "Min ($)", {_money('max(total_revenue)')} as "Max ($)"
        from metrics group by customer_segment""",
    "status_funnel": f"""
        select status, count(*) as orders, {_avg('order_value')} as avg_order_value,
               {_avg('delivery_days')} as avg_delivery_days,
               cast(list_position(['approved', 'invoiced', 'processing', 'shipped', 'delivered',
                                   'canceled'], status) - 1 as integer) as order_rank
        from fct group by status""",
    "delivery_histogram": "select delivery_days, orders from histogram",
    "delivery_mean_median": """
        select round(cast(sum(delivery_days * orders) as double) / sum(orders), 1) as mean_days,
               min(case when reached >= total / 2 then delivery_days end) as median_days
        from (select *, sum(orders) over (order by delivery_days) as reached,
                     sum(orders) over () as total from histogram)""",
    "payment_breakdown": f"""
        select primary_payment_type as payment_type, count(*) as orders,
               {_money('sum(order_value)')} as total_revenue,
               {_avg('max_installments', 1)} as avg_installments,
               {_avg('order_value')} as avg_order_value
        from fct group by primary_payment_type""",
    "payment_reconciliation": """
        select coalesce(p.order_id, i.order_id) as order_id,
               cast(coalesce(total_payment, 0) as double) as paid,
               cast(coalesce(order_value, 0) as double) as items_total,
               cast(coalesce(total_payment, 0) - coalesce(order_value, 0) as double) as difference
        from payment_totals p full join item_totals i on p.order_id = i.order_id""",
    "zip_dimension": """
        select zip_code, city, state from (
            select *, row_number() over (partition by zip_code order by source, city, state) as rn
            from (select zip_code, city, state, 0 as source from stg_customers
                  union all select zip_code, city, state, 1 from stg_sellers))
        where rn = 1""",
    "cohort_activity": "select cohort_month, period, customers from activity",
    "retention_pct": "select cohort_month, cohort, period, retention_pct from rates",
    "retention_insight": """
        select round(coalesce(avg(case when period = 1 then retention_pct end), 0), 1)
                   as avg_month_1,
               round(coalesce(avg(case when period = 3 then retention_pct end), 0), 1)
                   as avg_month_3,
               coalesce((select cohort from rates where period = 1
                         order by retention_pct desc, cohort limit 1), 'N/A') as best_cohort
        from rates""",
    "event_day_gaps": """
        select user_id, min(ts) as first_at, max(ts) as last_at,
               datesub('day', min(ts), max(ts)) as days_between, count(*) as events
        from events group by user_id""",
    "cohort_matrix": """
        select cohort_month, place, period, customers
        from (select distinct cohort_month from activity)
        cross join (select period, cast(row_number() over (order by period) - 1 as integer) as place
                    from (select distinct period from activity))
        left join activity using (cohort_month, period)""",
    # The staged frames start from text tables, blemished and cleaned again.
    "stg_orders": "select * from clean_orders",
    "stg_customers": "select * from clean_customers",
    "stg_sellers": "select * replace (cast(seller_id as varchar) as seller_id) from stg_sellers",
    "stg_products": """
        select * exclude (brand) replace (cast(product_id as varchar) as product_id)
        from stg_products""",
    "stg_order_items": """
        select * replace (cast(price as double) as price,
                          cast(freight_value as double) as freight_value,
                          cast(total_amount as double) as total_amount) from clean_items""",
    "stg_order_payments": """
        select * replace (cast(payment_value as double) as payment_value) from clean_payments""",
    "stg_order_reviews": "select * from clean_reviews",
    "quality_report": _with_total(" union all ".join(
        [
            _report("customers_dataset", "customer", "customer",
                    dropped="count(*) filter (c_acctbal < 0)"),
            _report("sellers_dataset", "supplier", "supplier"),
            _report("products_dataset", "part", "part"),
            _report("orders_dataset", "stg_orders", "stg_orders",
                    blanks="sum(cast(approved_at is null as int) + cast(shipped_at is null as int)"
                           " + cast(delivered_at is null as int))"),
            _report("order_items_dataset", "stg_order_items", "clean_items",
                    rows="sum(case l_returnflag when 'R' then 2 else 1 end)",
                    invalid="count(*) filter (freight_value is null)"),
            _report("order_payments_dataset", "stg_order_payments", "clean_payments"),
            _report("order_reviews_dataset", "stg_order_reviews", "clean_reviews"),
            _report("geolocation_dataset", "nation", "nation",
                    invalid="count(*) filter (n_regionkey = 0)"),
            _report("product_category_name_translation", "translated", "translated"),
        ]
    )),
    "constraint_violations": " union all ".join(
        [
            _unique("stg_orders", "clean_orders", "order_id"),
            _unique("stg_customers", "clean_customers", "customer_id"),
            _unique("stg_order_reviews", "clean_reviews", "review_id"),
            _unique("stg_products", "stg_products", "product_id"),
            _unique("stg_sellers", "stg_sellers", "seller_id"),
            _not_null("stg_orders", "clean_orders", "order_id"),
            _not_null("stg_orders", "clean_orders", "customer_id"),
            _not_null("stg_customers", "clean_customers", "customer_id"),
            _not_null("stg_order_items", "clean_items", "order_id"),
            _not_null("stg_order_items", "clean_items", "price"),
            _not_null("stg_order_payments", "clean_payments", "order_id"),
            _not_null("stg_order_reviews", "clean_reviews", "review_id"),
            _not_null("stg_products", "stg_products", "product_id"),
            _not_null("stg_sellers", "stg_sellers", "seller_id"),
            _accepted("stg_orders", "clean_orders", "status",
                      "delivered shipped canceled processing invoiced approved"),
            _accepted("stg_order_payments", "clean_payments", "payment_type",
                      "credit_card boleto voucher debit_card"),
        ]
    ),
    "category_purchases": """
        select customer_unique_id, product_category, purchase_count,
               cast(total_spent as double) as total_spent from purchases""",
    "user_item_matrix": "select customer_unique_id, "
    + ", ".join(
        f"cast(coalesce(sum(purchase_count) filter (product_category = 'Brand#{b}'), 0) as bigint)"
        f' as "Brand#{b}"' for b in range(1, 26)
    )
    + " from purchases group by customer_unique_id",
    "category_popularity": """
        select product_category, cast(sum(purchase_count) as bigint) as purchases
        from purchases group by product_category""",
    "top_category_popularity": """
        select product_category, cast(sum(purchase_count) as bigint) as purchases
        from purchases group by product_category
        order by purchases desc, product_category limit 15""",
    "matrix_stats": """
        select customers, categories,
               round(1 - filled / cast(customers * categories as double), 6) as sparsity
        from (select count(distinct customer_unique_id) as customers,
                     count(distinct product_category) as categories, count(*) as filled
              from purchases)""",
    "similar_customers": """
        select x as customer_unique_id, cast(place as integer) as place, y as neighbour, similarity
        from neighbours""",
    "similar_customers_sparse": """
        select x as customer_unique_id, cast(place as integer) as place, y as neighbour, similarity
        from neighbours""",
    "similar_customers_pruned": """
        select x as customer_unique_id, cast(place as integer) as place, y as neighbour, similarity
        from neighbours""",
    "recommendations": """
        select customer_unique_id, cast(place as integer) as place, category, category as label,
               score from recs""",
    "recommendation_text": """
        select substr(cast(n.id as varchar), 1, 12) || '...' as customer_id,
               (select string_agg(c, ', ' order by c) from (
                    select product_category as c from purchases
                    where customer_unique_id = n.id order by c limit 3)) as bought,
               coalesce((select string_agg(category, ', ' order by place) from recs
                         where customer_unique_id = n.id), 'none') as recommendations
        from (select id from norms order by id limit 5) n""",
    "already_purchased": """
        select customer_unique_id,
               string_agg(product_category, ', ' order by product_category) as already_purchased
        from purchases group by customer_unique_id""",
    "hash_embedding": """
        select id as doc_id, cast(i as integer) as component, vec[i + 1] as value
        from document_vectors, range(64) t(i)""",
    "vector_topk": """
        select vec_id, cast(place as integer) as place, neighbour_id,
               round(cosine, 10) as similarity
        from (select *, row_number() over (partition by vec_id
                                           order by round(cosine, 10) desc, neighbour_id) as place
              from (select a.vec_id, b.vec_id as neighbour_id,
                           list_cosine_similarity(cast(a.embedding as double[]),
                                                  cast(b.embedding as double[])) as cosine
                    from embeddings a join embeddings b on a.vec_id <> b.vec_id))
        where place <= 3""",
    "question_matches": """
        select question_id, cast(place as integer) as place, document_id,
               round(cosine, 10) as similarity from question_top""",
    "question_context": """
        select question_id, cast(length(context) as integer) as n_chars,
               md5(context) as context_md5
        from (select question_id, string_agg(text, chr(10) || chr(10) order by place) as context
              from question_top group by question_id)""",
    "insight_documents": f"""
        select 'kpi_overview' as id,
               concat_ws(chr(10) || '        ', 'Overall Business KPIs:',
                   'Total delivered orders: ' || orders, 'Total unique customers: ' || customers,
                   'Total revenue: R$ ' || {_two('revenue')},
                   'Average order value: R$ ' || {_two('value')},
                   'Average review score: ' || {_two('score')} || ' out of 5',
                   'On-time delivery rate: ' || {_two('on_time')} || '%') as text
        from (select count(distinct order_id) as orders,
                     count(distinct customer_unique_id) as customers,
                     sum(order_value) as revenue, {_avg('order_value')} as value,
                     {_avg('review_score')} as score,
                     round(sum(case when delivered_on_time then 1 else 0 end) * 100.0::double
                           / count(*), 2) as on_time
              from fct where status = 'delivered')
        union all
        select 'customer_segments', 'Customer Segments:' || chr(10) || string_agg(
                   '  ' || customer_segment || ': ' || n || ' customers, avg revenue R$ '
                   || {_two('revenue')} || ', avg ' || {_two('orders')} || ' orders' || chr(10), ''
                   order by revenue desc, customer_segment)
        from (select customer_segment, count(*) as n, {_avg('total_revenue')} as revenue,
                     round(avg(total_orders), 2) as orders from dim group by customer_segment)
        union all
        select 'top_categories', 'Top 10 Product Categories by Revenue:' || chr(10) || string_agg(
                   '  ' || product_category || ': R$ ' || {_two('revenue')} || ' from ' || orders
                   || ' orders' || chr(10), '' order by revenue desc, product_category)
        from (select product_category, sum(total_amount) as revenue,
                     count(distinct order_id) as orders
              from int_items group by product_category
              order by revenue desc, product_category limit 10)
        union all
        select 'payment_types', 'Payment Type Breakdown:' || chr(10) || string_agg(
                   '  ' || coalesce(primary_payment_type, 'None') || ': ' || n || ' orders, avg R$ '
                   || coalesce({_two('value')}, 'None') || chr(10), ''
                   order by n desc, primary_payment_type)
        from (select primary_payment_type, count(*) as n, {_avg('order_value')} as value
              from fct group by primary_payment_type)
        union all
        select 'state_performance', 'Top 10 States by Revenue:' || chr(10) || string_agg(
                   '  ' || customer_state || ': R$ ' || {_two('revenue')} || ' from ' || orders
                   || ' orders' || chr(10), '' order by revenue desc, customer_state)
        from (select customer_state, sum(order_value) as revenue,
                     count(distinct order_id) as orders
              from fct where status = 'delivered' group by customer_state
              order by revenue desc, customer_state limit 10)
        union all
        select 'churn_stats', 'Churn Analysis:' || chr(10) || string_agg(
                   '  ' || case when is_churned = 1 then 'Churned' else 'Active' end || ': ' || n
                   || ' customers, avg revenue R$ ' || {_two('revenue')} || chr(10), ''
                   order by is_churned)
        from (select is_churned, count(*) as n, {_avg('total_revenue')} as revenue
              from metrics group by is_churned)""",
    "numeric_summary": " union all ".join(
        f"""select '{c}' as feature, count({c}) as count, round(avg({c}), 2) as mean,
                   round(stddev_samp({c}), 2) as std, round(min({c}), 2) as min,
                   round(quantile_cont({c}, 0.25), 2) as q25, round(median({c}), 2) as median,
                   round(quantile_cont({c}, 0.75), 2) as q75, round(max({c}), 2) as max
            from churn_frame"""
        for c in FEATURES
    ),
    "imputed_features": "select * replace ("
    + ", ".join(f"coalesce({c}, (select median({c}) from churn_frame)) as {c}" for c in FEATURES)
    + ") from churn_frame",
    "one_hot": "select customer_unique_id, "
    + ", ".join(
        f"cast(customer_state = 'NATION_{n}' as double) as \"customer_state_NATION_{n}\""
        for n in range(1, 25)
    )
    + " from churn_frame",
    "stratified_split": """
        select customer_unique_id, is_churned, rn <= floor(n * 0.2 + 0.5) as is_test,
               cast(cast(rn > floor(n * 0.2 + 0.5) as int) + cast(rn > floor(n * 0.4 + 0.5) as int)
                    + cast(rn > floor(n * 0.6 + 0.5) as int)
                    + cast(rn > floor(n * 0.8 + 0.5) as int) as integer) as fold
        from marked""",
    "base_rates": """
        select round(avg(is_churned), 6) as overall,
               round(avg(is_churned) filter (not t), 6) as train,
               round(avg(is_churned) filter (t), 6) as test, count(*) filter (t) as test_rows
        from (select *, rn <= floor(n * 0.2 + 0.5) as t from marked)""",
    "churn_split_gains": f"""
        with train as (
            select i.*, case when i.is_churned = 1 then 2.0 else 1.0 end as w
            from (select * replace ({', '.join(f'coalesce({c}, (select median({c}) from churn_frame)) as {c}' for c in FEATURES)})
                  from churn_frame) i
            join marked m using (customer_unique_id)
            where m.rn > floor(m.n * 0.2 + 0.5)
        ), share as (select sum(w * is_churned) / sum(w) as p from train),
        long as (
            {' union all '.join(f"select '{c}' as feature, {c} as x, is_churned as y, w from train" for c in FEATURES)}
        ), cuts as (
            select distinct feature, unnest(quantile_disc(x, [{', '.join(str(k / 16) for k in range(1, 16))}])) as cut
            from long group by feature
        ), flags as (
            select feature, 0.0 as cut, cast(customer_state = v as int) as x, is_churned as y, w
            from train cross join (select v, 'customer_state_' || v as feature
                                   from (select distinct customer_state as v from train)
                                   where v > (select min(customer_state) from train))
        ), sides as (
            select feature, cut, x <= cut as l, y, w from cuts join long using (feature)
            union all select feature, cut, x <= cut, y, w from flags
        ), sums as (
            select feature, cut,
                   sum(w * (p - y)) filter (l) as gl, sum(w * p * (1 - p)) filter (l) as hl,
                   sum(w * (p - y)) filter (not l) as gr, sum(w * p * (1 - p)) filter (not l) as hr
            from sides, share group by feature, cut
        )
        select feature, cast(cut as double) as cut,
               round(gl * gl / (hl + 1) + gr * gr / (hr + 1)
                     - (gl + gr) * (gl + gr) / (hl + hr + 1), 3) as gain
        from sums where hl >= 1 and hr >= 1""",
    "probed_topk_quality": """
        select count(distinct vec_id) as queries, 0::bigint as wrong_scores, true as recall_reached
        from embeddings""",
    "viewed_stg_orders": "select * from clean_orders",
    "stored_matrix": """
        select customer_unique_id, product_category, cast(purchase_count as bigint) as purchase_count
        from purchases where customer_unique_id is not null""",
    "feature_matrix": " union all ".join(
        f"""select customer_unique_id, '{c}' as feature,
                   coalesce({c}, (select median({c}) from churn_frame)) as value
            from churn_frame where coalesce({c}, (select median({c}) from churn_frame)) <> 0"""
        for c in FEATURES
    )
    + """ union all select customer_unique_id, 'customer_state_' || customer_state, 1.0::double
         from churn_frame where customer_state <> (select min(customer_state) from churn_frame)""",
    "churn_model_consistency": """
        select count(*) as rows, 0::bigint as outside, 0::bigint as undecided, 0::bigint as out_of_order
        from marked where rn <= floor(n * 0.2 + 0.5)""",
    "clv_model_consistency": """
        select cast(floor(count(*) * 0.2 + 0.5) as bigint) as rows, 0::bigint as wrong_errors,
               0::bigint as out_of_order
        from metrics where total_revenue > 0""",
    "model_importance_totals": f"""
        select 'churn' as model, cast({len(FEATURES)} + count(distinct customer_state) - 1 as integer) as features,
               1.0::double as total, 0::integer as negative
        from churn_frame join marked using (customer_unique_id) where rn > floor(n * 0.2 + 0.5)
        union all
        select 'clv', cast(11 + count(distinct customer_state) - 1 as integer), 1.0::double, 0::integer
        from (select customer_state, row_number() over (order by md5(customer_unique_id || '#42')) as rn,
                     count(*) over () as n from metrics where total_revenue > 0)
        where rn > floor(n * 0.2 + 0.5)""",
    "rule_importance": """
        with numbered as (
            select row_number() over (order by customer_unique_id) - 1 as i, is_churned as y,
                   cast(recency_days as double) as a, cast(total_items as double) as b,
                   cast(total_revenue as double) as c
            from metrics
        ), step as (
            select n, (select min(k) from range(cast(floor(n * 0.6180339887) as bigint) + 1, 2 * n + 2) t(k)
                       where gcd(k, n) = 1) as f
            from (select count(*) as n from numbered)
        ), met as (
            select own.*, d.a as a2, d.b as b2, d.c as c2
            from numbered d, step join numbered own on own.i = (d.i * f + 42 % n) % n
        ), scored as (
            select y, a, b, c, a2, b2, c2, a - 10 * b - floor(c / 1000) as s,
                   a2 - 10 * b - floor(c / 1000) as sa, a - 10 * b2 - floor(c / 1000) as sb,
                   a - 10 * b - floor(c2 / 1000) as sc
            from met
        ), tried as (
            select '' as feature, y, s, 0.0 as change, 0.0 as moved from scored
            union all select 'recency_days', y, sa, sa - s, a2 - a from scored
            union all select 'total_items', y, sb, sb - s, b2 - b from scored
            union all select 'total_revenue', y, sc, sc - s, c2 - c from scored
        ), ties as (
            select feature, s, count(*) filter (y = 1) as p, count(*) filter (y = 0) as q
            from tried where s is not null group by feature, s
        ), areas as (
            select feature, sum(p * (below + q / 2.0)) / (sum(p) * sum(q)) as auc
            from (select *, sum(q) over (partition by feature order by s) - q as below from ties)
            group by feature
        )
        select feature, round(base - auc, 6) as importance, round(size, 6) as mean_effect,
               round(coalesce(way, 0.0), 4) as direction
        from areas
        join (select feature, avg(abs(change)) as size,
                     covar_pop(moved, change) / nullif(stddev_pop(moved) * stddev_pop(change), 0) as way
              from tried group by feature) e using (feature),
             (select auc as base from areas where feature = '') b
        where feature <> ''""",
    "revenue_stats": """
        select round(avg(v), 2) as mean_revenue, round(median(v), 2) as median_revenue,
               round(max(v), 2) as max_revenue
        from (select cast(total_revenue as double) as v from metrics where total_revenue > 0)""",
    "confusion_matrix": """
        select actual, predicted, count(is_churned) as rows
        from (select unnest([0, 0, 1, 1]) as actual, unnest([0, 1, 0, 1]) as predicted)
        left join metrics on is_churned = actual and 1 - active_last_180d = predicted
        group by actual, predicted""",
    "classification_report": """
        select round(tp / nullif(cast(claimed as double), 0), 6) as precision,
               round(tp / nullif(cast(real as double), 0), 6) as recall,
               round(2 * tp / nullif(cast(claimed + real as double), 0), 6) as f1
        from (select count(*) filter (is_churned = 1 and active_last_180d = 0) as tp,
                     count(*) filter (active_last_180d = 0) as claimed,
                     count(*) filter (is_churned = 1) as real from metrics)""",
    "roc_auc": """
        select round((sum(place) filter (is_churned = 1) - p * (p + 1) / 2.0) / (p * (c - p)), 6)
                   as auc
        from (select is_churned,
                     avg(r) over (partition by recency_days) as place,
                     count(*) filter (is_churned = 1) over () as p, count(*) over () as c
              from (select is_churned, recency_days,
                           row_number() over (order by recency_days) as r from metrics))
        group by p, c""",
    "regression_report": """
        select round(avg(abs(p - a)), 2) as mae, round(sqrt(avg((p - a) * (p - a))), 2) as rmse,
               round(1 - avg((p - a) * (p - a)) / var_pop(a), 4) as r2
        from (select cast(total_revenue as double) as a, cast(max_order_value as double) as p
              from metrics where total_revenue is not null)""",
}

# The same rows after a way through files or tables.
QUERIES |= {
    "landed_quality_report": QUERIES["quality_report"],
    "registered_stg_orders": QUERIES["stg_orders"],
    "stored_embedding": QUERIES["hash_embedding"],
    "stored_recommendations": QUERIES["recommendations"],
    "segments_of_versions": """
        select customer_segment, count(*) as customers from dim group by all
        union all select 'older', count(*) from dim""",
    "segments_by_sql": "select customer_segment, count(*) as customers from dim group by all",
}

QUERIES["observed_quality_report"] = QUERIES["quality_report"]

# Who a model is judged on is exact, whatever the model says.
QUERIES |= {
    "churn_model_heldout": """
        select customer_unique_id, is_churned as actual_churned
        from marked where rn <= floor(n * 0.2 + 0.5)""",
    "churn_model_margins": """
        select cast(is_churned as integer) as actual, cast(count(*) as bigint) as rows,
               cast(2 as bigint) as cells
        from marked where rn <= floor(n * 0.2 + 0.5) group by is_churned""",
    "clv_model_heldout": """
        select customer_unique_id, round(v, 2) as actual_revenue
        from (select customer_unique_id, cast(total_revenue as double) as v,
                     row_number() over (order by md5(customer_unique_id || '#42')) as rn,
                     count(*) over () as n
              from metrics where total_revenue > 0)
        where rn <= floor(n * 0.2 + 0.5)""",
}
