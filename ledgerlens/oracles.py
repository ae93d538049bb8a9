"""Independent DuckDB SQL for every registered query, over the same parquet tables.

Each statement starts from the ledger views of FIXTURES.md. They state the result a report
must have by the shortest route (global windows, quantile functions), not how Spark gets it.
"""

from __future__ import annotations

from ledgerlens import fixed_values as fv

# Settings the registered queries use where the test tables differ from a real ledger:
# transactions per active customer, and the event types standing in for the risky ones.
TRIALS = 67
RULE_TYPES = ("purchase", "error")
RULE_LABELS = (*fv.RULE_LABELS[:2], "R3: R2 or purchase/error")

# Reports also registered over the second ledger: decimal cents, many months.
ORDER_REPORTS = (
    "status_share",
    "type_value_skew",
    "monthly_activity",
    "monthly_trend",
    "value_deciles",
    "value_tiers",
    "gap_since_previous",
    "amount_outliers",
)

# The month that is added to the states of the months before it.
NEW_MONTH = "2024-02"

# Reports run on the ledger with missing amounts and times as well.
GAPPED_REPORTS = (
    "value_deciles",
    "value_tiers",
    "customer_rfm",
    "value_decile_share_all",
    "cumulative_value_curve",
    "gap_since_previous",
    "type_value_skew",
    "kpi_summary",
)

_LEDGER = """
ledger as (
  select event_id as txn_id, user_id as customer_id,
         ts + to_days(cast((event_id % 3) * 30 as int)) as txn_ts, event_type as txn_type,
         case when event_id % 50 < 21 then 'Mobile App' when event_id % 50 < 31 then 'POS'
              when event_id % 50 < 39 then 'Web' when event_id % 50 < 46 then 'ATM' else 'USSD' end as channel,
         round(value * 1000) as amount,
         case when k < 90 then 'Successful' when k < 95 then 'Failed'
              when k < 98 then 'Reversed' else 'Pending' end as status,
         case when event_id % 25 = 7 then 'Yes' else 'No' end as international,
         case when value >= 100 or (event_id * 7 + k) % 6 = 0 then 'Yes' else 'No' end as risk_flag
  from (select *, cast(regexp_extract(props, '([0-9]+)', 1) as int) as k from events)
)"""

_GAPPED = _LEDGER.replace("ledger as", "full_ledger as") + """,
ledger as (
  select * replace (case when customer_id % 11 = 5 or txn_id % 7 = 3 then null else amount end as amount,
                    case when txn_id % 13 = 4 then null else txn_ts end as txn_ts)
  from full_ledger
)"""

_ACCOUNT = """
account as (
  select c_custkey as customer_id, c_mktsegment as segment,
         case when c_custkey % 14 = 3 then 'Dormant' when c_custkey % 58 = 5 then 'Restricted'
              else 'Active' end as account_status,
         case when c_custkey % 50 < 31 then 'Mobile App' when c_custkey % 50 < 43 then 'Web'
              else 'USSD' end as preferred_channel,
         case when c_custkey % 9 = 0 then '' when c_custkey % 9 = 3 then '  '
              when c_custkey % 9 <> 6 then 'Phone' end as device_type,
         case when c_custkey % 11 = 0 then ''
              when c_custkey % 11 <> 5 then 'Nation ' || c_nationkey end as location
  from customer
)"""

_ORDERS = """
ledger as (
  select o_orderkey as txn_id, o_custkey as customer_id, o_orderdate as txn_ts, o_orderpriority as txn_type,
         cast(o_totalprice as decimal(18,2)) as amount,
         case o_orderstatus when 'F' then 'Successful' when 'P' then 'Pending' else 'Failed' end as status,
         case when o_custkey % 25 = 7 then 'Yes' else 'No' end as international,
         case when o_totalprice >= 300000 then 'Yes' else 'No' end as risk_flag
  from orders
)"""

_MODEL = """
model as (
  select l.*, a.segment, success_count / cast(txn_count as double) as success_rate,
         date_diff('second', last_txn, max(last_txn) over () + interval 1 day) // 86400 as recency_days
  from (select customer_id, count(txn_id) as txn_count,
               count(*) filter (status = 'Successful') as success_count,
               coalesce(sum(amount) filter (status = 'Successful'), 0) as value_success,
               count(*) filter (risk_flag = 'Yes') as flag_count,
               max(txn_ts) as last_txn
        from ledger group by all) l
  join account a using (customer_id)
)"""

_RFM = f"""
rfm as (
  select *, case  -- fixed rule, as in the agreed result
      when r_score >= {fv.HIGH_QUARTILE} and f_score >= {fv.HIGH_QUARTILE} and m_score >= {fv.HIGH_QUARTILE}
          then '{fv.QUARTILE_SEGMENTS[0]}'
      when r_score < {fv.HIGH_QUARTILE} and m_score >= {fv.HIGH_QUARTILE} then '{fv.QUARTILE_SEGMENTS[1]}'
      when f_score < {fv.HIGH_QUARTILE} and m_score < {fv.HIGH_QUARTILE} then '{fv.QUARTILE_SEGMENTS[2]}'
      else '{fv.QUARTILE_SEGMENTS[3]}' end as rfm_segment
  from (select *, ntile(4) over (order by recency_days desc, customer_id) as r_score,
                  ntile(4) over (order by frequency, customer_id) as f_score,
                  ntile(4) over (order by monetary, customer_id) as m_score
        from (select customer_id,
                     date_diff('day', max(txn_ts), (select max(txn_ts) from ledger)) as recency_days,
                     count(*) as frequency, sum(amount) as monetary
              from ledger where status = 'Successful' group by all))
)"""

_QUINTILES = f"""
edges as (
  select quantile_cont(cast(recency_days as double), [0.2, 0.4, 0.6, 0.8]) as r,
         quantile_cont(cast(txn_count as double), [0.2, 0.4, 0.6, 0.8]) as f,
         quantile_cont(value_success, [0.2, 0.4, 0.6, 0.8]) as m
  from model
),
quintiles as (
  select *, case
      when r_score >= 4 and f_score >= 4 and m_score >= 4 then '{fv.QUINTILE_SEGMENTS[0]}'
      when r_score >= 3 and f_score >= 3 then '{fv.QUINTILE_SEGMENTS[1]}'
      when r_score <= 2 then '{fv.QUINTILE_SEGMENTS[2]}'
      else '{fv.QUINTILE_SEGMENTS[3]}' end as rfm_segment
  from (select model.*, 5 - len(list_filter(r, lambda e: recency_days > e)) as r_score,
               1 + len(list_filter(f, lambda e: txn_count > e)) as f_score,
               1 + len(list_filter(m, lambda e: value_success > e)) as m_score
        from model, edges)
)"""


def _banded(value: str, cuts, labels, op: str = "<") -> str:
    arms = " ".join(f"when {value} {op} {cut} then '{label}'" for cut, label in zip(cuts, labels))
    return f"case {arms} else '{labels[-1]}' end"


def _rate(condition: str, digits: int = 2) -> str:
    return f"round(100e0 * count(*) filter ({condition}) / count(*), {digits})"


_OK, _BAD, _FLAG, _ABROAD = "status = 'Successful'", "status = 'Failed'", "risk_flag = 'Yes'", "international = 'Yes'"

_LEDGER_SQL: dict[str, str] = {
    "status_share": """
        select status, count(*) as txn_count,
               round(100e0 * count(*) / (select count(*) from ledger), 2) as pct_of_txns,
               round(sum(amount)::double, 0) as total_value
        from ledger group by status""",
    "type_value_skew": f"""
        select txn_type, count(*) as txn_count, round(sum(amount)::double, 0) as total_value,
               round(avg(amount), 0) as avg_value, round(median(amount::double), 0) as median_value
        from ledger where {_OK} group by txn_type""",
    "channel_rates": f"""
        select channel, count(*) as txn_count, {_rate(_OK)} as success_rate_pct, {_rate(_BAD)} as failure_rate_pct
        from ledger group by channel""",
    "review_rate_by_type": f"""
        select txn_type, count(*) as txn_count, {_rate(_FLAG)} as review_rate_pct from ledger group by txn_type""",
    "international_profile": f"""
        select international, count(*) as txn_count, round(avg(amount), 0) as avg_value,
               {_rate(_FLAG)} as review_rate_pct, {_rate(_OK)} as success_rate_pct
        from ledger group by international""",
    "review_rate_by_amount_band": f"""
        select {_banded("amount", fv.AMOUNT_CUTS, fv.AMOUNT_LABELS)} as amount_band,
               count(*) as txn_count, {_rate(_FLAG)} as review_rate_pct
        from ledger group by 1""",
    "monthly_activity": f"""
        select strftime(date_trunc('month', txn_ts), '%Y-%m') as month, count(*) as txn_count,
               count(distinct txn_ts::date) as active_days,
               round(count(*)::double / count(distinct txn_ts::date), 0) as txns_per_day,
               round(avg(amount) filter ({_OK}), 0) as avg_successful
        from ledger group by 1""",
    "time_of_day_rates": f"""
        select {_banded("hour(txn_ts)", fv.HOUR_CUTS, fv.HOUR_LABELS)} as time_band, count(*) as txn_count,
               {_rate(_BAD)} as failure_rate_pct, {_rate(_FLAG)} as review_rate_pct,
               round(avg(amount), 0) as avg_value
        from ledger group by 1""",
    "value_not_completed": f"""
        select txn_type, round(sum(amount)::double, 0) as attempted_value,
               round(sum(amount) filter (not {_OK}), 0) as not_completed_value,
               round(100e0 * sum(amount) filter (not {_OK}) / sum(amount), 2) as pct_value_not_completed,
               round(avg(amount) filter ({_BAD}), 0) as avg_failed,
               round(avg(amount) filter ({_OK}), 0) as avg_successful
        from ledger group by txn_type""",
    "failure_lift_combos": f"""
        select channel, txn_type, n as txn_count, x as failed_txns,
               round(100e0 * x / n, 2) as failure_rate_pct, round(100 * base, 2) as platform_rate_pct,
               round((x / n::double) / base, 2) as failure_lift
        from (select channel, txn_type, count(*) as n, count(*) filter ({_BAD}) as x,
                     (select avg(cast({_BAD} as int)) from ledger) as base
              from ledger group by channel, txn_type)
        where n >= {fv.MIN_COMBO_ROWS}
        order by failure_lift desc, channel, txn_type limit {fv.TOP_COMBOS}""",
    "stratified_ratio": f"""
        select txn_type, count(*) filter ({_ABROAD}) as intl_txns,
               round(100 * avg(f) filter ({_ABROAD}), 2) as intl_review_rate_pct,
               round(100 * avg(f) filter (not {_ABROAD}), 2) as domestic_review_rate_pct,
               round(avg(f) filter ({_ABROAD}) / nullif(avg(f) filter (not {_ABROAD}), 0), 2) as intl_to_domestic_ratio
        from (select *, cast({_FLAG} as int) as f from ledger) group by txn_type""",
    "failure_distribution": f"""
        select x as failed_txns, count(*) as customers,
               round(100e0 * count(*) / sum(count(*)) over (), 2) as pct_customers,
               cast(sum(x) as bigint) as failed_txns_total
        from (select count(*) filter ({_BAD}) as x from ledger group by customer_id) group by x""",
    "value_deciles": f"""
        select cast(tenth as int) as decile, count(*) as customers, round(sum(v)::double, 0) as total_value,
               round(100e0 * sum(v) / sum(sum(v)) over (), 2) as pct_of_total_value
        from (select v, ntile(10) over (order by v desc, customer_id) as tenth
              from (select customer_id, sum(amount) as v from ledger where {_OK} group by customer_id))
        group by tenth""",
    "value_tiers": f"""
        select {_banded("h", fv.TIER_HUNDREDTHS, fv.TIER_LABELS, "<=")} as tier, count(*) as txn_count,
               round(sum(amount)::double, 0) as total_value,
               round(100e0 * sum(amount) / sum(sum(amount)) over (), 1) as pct_of_value,
               round(min(amount)::double, 0) as min_amount, {_rate(_FLAG, 1)} as review_rate_pct
        from (select *, ntile(100) over (order by amount desc, txn_id) as h from ledger where {_OK})
        group by tier""",
    "value_decile_share_all": """
        select cast(1 + len(list_filter(e, lambda x: rk > x)) as int) as decile, count(*) as customers,
               round(100e0 * sum(v) / sum(sum(v)) over (), 2) as share_pct
        from ranked, (select quantile_cont(rk, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) as e from ranked)
        group by 1""",
    "concentration_summary": """
        select round(100e0 * sum(v) filter (d = 1) / sum(v), 1) as top10_pct,
               round(100e0 * sum(v) filter (d <= 3) / sum(v), 1) as top30_pct,
               round(100e0 * sum(v) filter (d > 5) / sum(v), 1) as bottom50_pct
        from (select v, 1 + len(list_filter(e, lambda x: rk > x)) as d
              from ranked,
                   (select quantile_cont(rk, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) as e from ranked))""",
    "cumulative_value_curve": """
        select cast(rk as bigint) as customer_rank, customer_id,
               round(100e0 * rk / count(*) over (), 6) as pct_customers,
               round(100e0 * sum(v) over (order by rk) / sum(v) over (), 6) as cumulative_value_pct
        from ranked""",
    "customer_rfm": "select * from rfm",
    "rfm_segment_summary": """
        select rfm_segment, count(*) as customers,
               round(100e0 * count(*) / sum(count(*)) over (), 1) as pct_customers,
               round(avg(frequency), 1) as avg_txns, round(avg(monetary), 0) as avg_value,
               round(100e0 * sum(monetary) / sum(sum(monetary)) over (), 1) as pct_of_value
        from rfm group by rfm_segment""",
    "two_proportion_ztest": f"""
        select round(100 * p1, 2) as focus_failure_pct, round(100 * p2, 2) as other_failure_pct,
               round(100 * (p1 - p2), 2) as gap_pp, round(100 * (p1 - p2 - 1.96e0 * se), 2) as ci95_low_pp,
               round(100 * (p1 - p2 + 1.96e0 * se), 2) as ci95_high_pp, round(z, 2) as z_score,
               if(abs(z) >= 1.96e0, '{fv.SIGNIFICANT}', '{fv.NOT_SIGNIFICANT}') as conclusion
        from (select *, sqrt(p1 * (1 - p1) / n1 + p2 * (1 - p2) / n2) as se,
                     (p1 - p2) / sqrt(p * (1 - p) * (1 / n1::double + 1 / n2::double)) as z
              from (select count(*) filter (m) as n1, count(*) filter (not m) as n2, avg(x) as p,
                           avg(x) filter (m) as p1, avg(x) filter (not m) as p2
                    from (select channel = 'Mobile App' as m, cast({_BAD} as int) as x from ledger)))""",
    "failure_concentration_test": f"""
        select count(*) as customers, count(*) filter (x >= 3) as observed,
               round(count(*) * any_value(tail), 1) as expected_if_random
        from (select count(*) filter ({_BAD}) as x from ledger group by customer_id),
             (select 1 - list_sum([coalesce(list_product([({TRIALS} - j) / (j + 1)::double for j in range(i)]), 1)
                                   * p ** i * (1 - p) ** ({TRIALS} - i) for i in range(3)]) as tail
              from (select avg(cast({_BAD} as int)) as p from ledger))""",
    "rule_scorecard": f"""
        select rule, count(*) filter (hit) as txns_selected, {_rate("hit", 1)} as pct_of_volume,
               round(100e0 * count(*) filter (hit and {_FLAG}) / count(*) filter (hit), 1) as precision_pct,
               round(100e0 * count(*) filter (hit and {_FLAG}) / count(*) filter ({_FLAG}), 1) as recall_pct,
               round((count(*) filter (hit and {_FLAG}) / (count(*) filter (hit))::double)
                     / (count(*) filter ({_FLAG}) / count(*)::double), 2) as lift
        from (select risk_flag, unnest([
                {{'rule': '{RULE_LABELS[0]}', 'hit': amount >= 100000}},
                {{'rule': '{RULE_LABELS[1]}', 'hit': amount >= 100000 or {_ABROAD}}},
                {{'rule': '{RULE_LABELS[2]}',
                  'hit': amount >= 100000 or {_ABROAD} or txn_type in {RULE_TYPES}}}], recursive := true)
              from ledger)
        group by rule""",
    "pending_age": f"""
        select {_banded("days", fv.AGE_CUTS, fv.AGE_LABELS, "<=")} as pending_age, count(*) as pending_txns,
               round(sum(amount)::double, 0) as value_in_limbo,
               round(100e0 * count(*) / sum(count(*)) over (), 1) as pct_of_pending
        from (select *, (max(txn_ts) over ())::date - txn_ts::date as days from ledger)
        where status = 'Pending' group by 1""",
    "gap_since_previous": f"""
        select case when gap is null then '{fv.FIRST_LABEL}'
                    else {_banded("gap", fv.GAP_CUTS, fv.GAP_LABELS, "<=")} end as gap_since_previous,
               count(*) as txn_count, {_rate(_FLAG)} as review_rate_pct
        from (select risk_flag, date_diff('minute', lag(txn_ts) over
                       (partition by customer_id order by txn_ts, txn_id), txn_ts) as gap from ledger)
        group by 1""",
    "kpi_summary": f"""
        select count(*) as total_transactions, count(distinct customer_id) as active_customers,
               {_rate(_OK)} as success_rate_pct, {_rate("status in ('Failed', 'Reversed')")} as failed_or_reversed_pct,
               round(sum(amount) filter ({_OK}), 0) as successful_value,
               round(median(amount) filter ({_OK}), 0) as median_successful,
               {_rate(_FLAG)} as review_rate_pct, {_rate(_ABROAD)} as international_share_pct
        from ledger""",
    "preview_transactions": "select * from ledger order by txn_id limit 5",
    "load_transactions": "select * from ledger",
    "derived_columns": f"""
        select *, strftime(txn_ts, '%Y-%m') as month, cast({_OK} as int) as is_success, cast({_FLAG} as int) as is_flag
        from ledger""",
    "profile_duplicates_transactions": """
        select (select count(*) from ledger) - (select count(*) from (select distinct * from ledger)) as duplicate_rows""",
    "status_value_counts": """
        select status, count(*) as rows, round(100e0 * count(*) / sum(count(*)) over (), 2) as share_pct
        from ledger where status is not null group by status""",
    "value_by_type_millions": f"""
        select txn_type, round(sum(amount) / 1e6, 6) as value_millions from ledger where {_OK} group by txn_type""",
    "log_histogram": """
        select b as bin, round(lo + (b - 1) * (hi - lo) / 60, 6) as log10_from,
               round(lo + b * (hi - lo) / 60, 6) as log10_to, count(x) as rows
        from (select unnest(range(1, 61)) as b),
             (select min(log10(amount)) as lo, max(log10(amount)) as hi from ledger where amount > 0)
             left join (select log10(amount) as x from ledger where amount > 0)
               on b = 1 + least(59, floor((x - lo) / ((hi - lo) / 60)))
        group by b, lo, hi""",
    "box_stats": """
        select txn_type, round(q[1], 4) as q1, round(q[2], 4) as median, round(q[3], 4) as q3,
               round(min(amount) filter (amount >= q[1] - 1.5e0 * (q[3] - q[1])), 4) as whisker_low,
               round(max(amount) filter (amount <= q[3] + 1.5e0 * (q[3] - q[1])), 4) as whisker_high
        from ledger join (select txn_type, quantile_cont(amount, [0.25, 0.5, 0.75]) as q from ledger group by 1)
             using (txn_type)
        group by txn_type, q""",
    "amount_outliers": """
        select round(avg(amount), 2) as mean, round(median(amount::double), 2) as median,
               round(skewness(amount::double), 4) as skewness, round(any_value(bound), 2) as upper_bound,
               count(*) filter (amount > bound) as outliers,
               round(100e0 * count(*) filter (amount > bound) / count(*), 1) as outlier_pct,
               round(max(amount)::double, 2) as maximum
        from ledger, (select q[2] + 1.5e0 * (q[2] - q[1]) as bound
                      from (select quantile_cont(amount::double, [0.25, 0.75]) as q from ledger))""",
    "failure_rate_by_channel": f"""
        select channel, {_rate(_BAD)} as failure_rate_pct from ledger group by channel""",
    "review_rate_by_type_1dp": f"""
        select txn_type, {_rate(_FLAG, 1)} as review_rate_pct from ledger group by txn_type""",
    "crosstab": f"""
        select international, count(*) filter (not {_FLAG}) as "No", count(*) filter ({_FLAG}) as "Yes"
        from ledger group by international""",
    "chi_square_independence": f"""
        select round(c, 6) as chi2, cast(1 as bigint) as dof,
               round(1 - 2 / sqrt(pi()) * list_sum([(-1) ** i * sqrt(c / 2) ** (2 * i + 1)
                     / (factorial(i::int) * (2 * i + 1)) for i in range(30)]), 4) as p_value,
               c > 3.841458820694124e0 as significant
        from (select n * greatest(0, abs(yy * nn - yn * ny) - n / 2) ** 2
                     / ((yy + yn) * (ny + nn) * (yy + ny) * (yn + nn)) as c
              from (select count(*)::double as n,
                           (count(*) filter ({_ABROAD} and {_FLAG}))::double as yy,
                           (count(*) filter ({_ABROAD} and not {_FLAG}))::double as yn,
                           (count(*) filter (not {_ABROAD} and {_FLAG}))::double as ny,
                           (count(*) filter (not {_ABROAD} and not {_FLAG}))::double as nn
                    from ledger))""",
    "expected_counts": """
        select a.international, b.risk_flag, count(l.txn_id) as observed,
               round(any_value(a.n) * any_value(b.n)::double / (select count(*) from ledger), 4) as expected
        from (select international, count(*) as n from ledger group by 1) a,
             (select risk_flag, count(*) as n from ledger group by 1) b
             left join ledger l on l.international = a.international and l.risk_flag = b.risk_flag
        group by 1, 2""",
    "risk_pivot": f"""
        select txn_type, {", ".join(f'round(avg(cast({_FLAG} as int)) filter (channel = {c!r}), 6) as "{c}"' for c in fv.CHANNELS)}
        from ledger group by txn_type""",
    "monthly_trend": f"""
        select month, round(v, 2) as total_value, txn_count, flag_count,
               round(v / lag(v) over (order by month) - 1, 6) as mom_growth
        from (select strftime(txn_ts, '%Y-%m') as month, sum(amount)::double as v, count(*) as txn_count,
                     count(*) filter ({_FLAG}) as flag_count
              from ledger group by 1)""",
    "reconcile_risk_matrix": f"""
        select txn_type, channel as measure, r as left_value, r as right_value, true as matches
        from (select txn_type, channel, round(avg(cast({_FLAG} as int)), 6) as r from ledger group by all)""",
    "reconcile_kpi": f"""
        select 'all' as scope, measure, v as left_value, v as right_value, true as matches
        from (select unnest(['total_transactions', 'successful_transactions', 'successful_value']) as measure,
                     unnest([count(*)::double, count(*) filter ({_OK})::double, (sum(amount) filter ({_OK}))::double]) as v
              from ledger)""",
}

_BOTH_SQL: dict[str, str] = {
    "relationship_check": """
        select (select count(*) from account) as customer_records, (select count(*) from ledger) as transaction_records,
               (select count(*) from ledger anti join account using (customer_id)) as orphan_transactions,
               (select count(*) from account anti join ledger using (customer_id)) as customers_without_transactions""",
    "segment_behaviour": f"""
        select segment, count(distinct customer_id) as customers, count(*) as txn_count,
               round(count(*)::double / count(distinct customer_id), 1) as txns_per_customer,
               round(sum(amount) / count(distinct customer_id), 0) as value_per_customer
        from ledger join account using (customer_id) where {_OK} group by segment""",
    "account_status_activity": """
        select account_status, count(distinct customer_id) as customers, count(*) as txn_count,
               round(count(*)::double / count(distinct customer_id), 1) as txns_per_customer
        from ledger join account using (customer_id) group by account_status""",
    "preferred_channel_match": f"""
        select preferred_channel, count(*) as txn_count,
               {_rate("channel = preferred_channel")} as pct_txns_on_preferred_channel
        from ledger join account using (customer_id) group by preferred_channel""",
    "account_status_exposure": f"""
        select account_status, count(distinct customer_id) as customers, count(*) filter ({_OK}) as successful_txns,
               round(sum(amount) filter ({_OK}), 0) as successful_value,
               round(100e0 * sum(amount) filter ({_OK}) / sum(sum(amount) filter ({_OK})) over (), 2) as pct_of_value,
               {_rate(_FLAG)} as review_rate_pct
        from ledger join account using (customer_id) group by account_status""",
    "merge_left_check": """
        select count(*) as row_total, cast(14 as bigint) as column_total,
               cast(sum(list_sum([cast(x is null as int) for x in
                 [txn_id::varchar, customer_id::varchar, txn_ts::varchar, txn_type, channel, amount::varchar, status,
                  international, risk_flag, segment, account_status, preferred_channel, device_type, location]]))
                 as bigint) as null_total
        from ledger left join account using (customer_id)""",
}

_ACCOUNT_SQL: dict[str, str] = {
    "preview_customers": "select * from account order by customer_id limit 5",
    "load_customers": "select * from account",
    "clean_ledger": """
        select * replace (coalesce(nullif(trim(device_type), ''), 'Unknown') as device_type,
                          coalesce(nullif(trim(location), ''), 'Unknown') as location)
        from account""",
    "profile_duplicates_customers": """
        select (select count(*) from account) - (select count(*) from (select distinct * from account)) as duplicate_rows""",
    "preferred_channel_value_counts": """
        select preferred_channel, count(*) as rows, round(100e0 * count(*) / sum(count(*)) over (), 2) as share_pct
        from account group by preferred_channel""",
}

_MODEL_SQL: dict[str, str] = {
    "customer_model": """
        select customer_id, txn_count, success_count, value_success, flag_count, last_txn, success_rate, segment
        from model""",
    "pareto_share": """
        select round(sum(value_success) filter (rk <= floor(n * 0.1e0)) / sum(value_success), 6) as top_share,
               round(1 - sum(value_success) filter (rk <= floor(n * 0.5e0)) / sum(value_success), 6) as bottom_share
        from (select value_success, count(*) over () as n,
                     row_number() over (order by value_success desc, customer_id) as rk from model)""",
    "customer_value_outliers": """
        select customer_id, round(value_success, 2) as value_success, round(cutoff, 2) as cutoff
        from model, (select q[2] + 1.5e0 * (q[2] - q[1]) as cutoff
                     from (select quantile_cont(value_success, [0.25, 0.75]) as q from model))
        where value_success > cutoff""",
}

_RANKED = """
ranked as (
  select customer_id, v, row_number() over (order by v desc, customer_id) as rk
  from (select customer_id, sum(amount) as v from ledger group by customer_id)
)"""

_METRICS = ("txn_count", "success_rate", "flag_count", "recency_days", "value_success")


def _long_profile(table: str, columns: dict[str, str], cell: str) -> str:
    return " union all ".join(cell.format(i=i, c=c, t=t, table=table, width=len(columns)) for i, (c, t) in enumerate(columns.items(), 1))


_LEDGER_TYPES = {
    "txn_id": "bigint",
    "customer_id": "bigint",
    "txn_ts": "timestamp_ntz",
    "txn_type": "string",
    "channel": "string",
    "amount": "double",
    "status": "string",
    "international": "string",
    "risk_flag": "string",
}
_ACCOUNT_TYPES = {
    "customer_id": "bigint",
    "segment": "string",
    "account_status": "string",
    "preferred_channel": "string",
    "device_type": "string",
    "location": "string",
}
_SHAPE = """
    select (select count(*) from {table}) as row_total, cast({width} as bigint) as column_total,
           cast({i} as bigint) as position, '{c}' as column_name, '{t}' as data_type, count({c}) as non_null
    from {table}"""
_NULLS = "select '{c}' as column_name, count(*) - count({c}) as nulls from {table}"
_DESCRIBE = """
    select '{c}' as column_name, count({c}) as count, round(avg({c}), 4) as mean, round(stddev_samp({c}), 4) as std,
           min({c})::double as min, quantile_cont({c}::double, 0.25) as p25, quantile_cont({c}::double, 0.5) as p50,
           quantile_cont({c}::double, 0.75) as p75, max({c})::double as max
    from {table}"""


_INFERRED = """
    select '{c}' as column_name, count({c}) as non_null, case when count({c}) = 0 then 'string'
           when count(*) filter (not regexp_full_match(trim({c}::varchar), '-?[0-9]+')) = 0 then 'bigint'
           when count(*) filter ({c} is not null and try_cast({c}::varchar as double) is null) = 0 then 'double'
           when count(*) filter ({c} is not null and try_cast({c}::varchar as timestamp) is null) = 0 then 'timestamp_ntz'
           else 'string' end as data_type
    from {table}"""


def _shape(table: str, columns: dict[str, str]) -> str:
    return _long_profile(table, columns, _SHAPE)


def _nulls(table: str, columns: dict[str, str]) -> str:
    cells = _long_profile(table, columns, _NULLS)
    return f"select column_name, nulls, cast(sum(nulls) over () as bigint) as frame_nulls from ({cells})"


def _numeric(columns: dict[str, str]) -> dict[str, str]:
    return {c: t for c, t in columns.items() if t in ("bigint", "double")}


def _with(*ctes: str) -> str:
    return "with " + ",".join(ctes)


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for name, sql in _LEDGER_SQL.items():
        ctes = [_LEDGER]
        if "ranked" in sql:
            ctes.append(_RANKED)
        if "from rfm" in sql:
            ctes.append(_RFM)
        out[name] = _with(*ctes) + sql
    out.update({name: _with(_LEDGER, _ACCOUNT) + sql for name, sql in _BOTH_SQL.items()})
    out.update({name: _with(_ACCOUNT) + sql for name, sql in _ACCOUNT_SQL.items()})
    out.update({name: _with(_LEDGER, _ACCOUNT, _MODEL) + sql for name, sql in _MODEL_SQL.items()})

    out["rfm_vs_labels"] = _with(_LEDGER, _ACCOUNT, _RFM) + """
        select segment, round(100e0 * count(*) filter (rfm_segment = 'Champions') / count(*), 1) as pct_champions,
               round(100e0 * count(*) filter (rfm_segment = 'At-risk high value') / count(*), 1) as pct_at_risk_high_value,
               round(100e0 * count(*) filter (rfm_segment = 'Low engagement') / count(*), 1) as pct_low_engagement,
               count(*) as customers
        from rfm join account using (customer_id) group by segment"""
    quintiles = _with(_LEDGER, _ACCOUNT, _MODEL, _QUINTILES)
    out["rfm_quintiles"] = quintiles + " select * from quintiles"
    out["rfm_quintile_summary"] = quintiles + """
        select rfm_segment, count(*) as customers, round(sum(value_success), 2) as total_value
        from quintiles group by rfm_segment"""
    pairs = " union all ".join(
        f"select '{a}' as metric_x, '{b}' as metric_y, round(corr({a}, {b}), 6) as correlation from model"
        for a in _METRICS
        for b in _METRICS
    )
    out["correlation_matrix"] = _with(_LEDGER, _ACCOUNT, _MODEL) + pairs

    for part, cte, table, types in (
        ("transactions", _LEDGER, "ledger", _LEDGER_TYPES),
        ("customers", _ACCOUNT, "account", _ACCOUNT_TYPES),
    ):
        out[f"profile_shape_{part}"] = _with(cte) + _shape(table, types)
        out[f"profile_nulls_{part}"] = _with(cte) + _nulls(table, types)
        out[f"profile_describe_{part}"] = _with(cte) + _long_profile(table, _numeric(types), _DESCRIBE)

        out[f"inferred_types_{part}"] = _with(cte) + _long_profile(table, types, _INFERRED)
    # Merged states give what the ledger gives.
    out["state_customer_rfm"] = out["customer_rfm"]
    out["state_customer_model"] = out["customer_model"]
    out["reconcile_ledger_rows"] = _with(_LEDGER) + """
        , other as (
          select * replace (case when txn_id % 499 = 5 then amount + 1 else amount end as amount,
                            case when txn_id % 499 = 5 and txn_id % 2 = 0 then null else channel end as channel)
          from ledger, range(case when txn_id % 991 = 3 then 2 else 1 end) where txn_id % 997 <> 11),
        sides as (select columns(l.*), 1 as l, 0 as r from ledger l
                  union all by name select * exclude (range), 0 as l, 1 as r from other),
        per_row as (select * exclude (l, r), greatest(sum(l) - sum(r), 0) as l, greatest(sum(r) - sum(l), 0) as r
                    from sides group by all having sum(l) <> sum(r)),
        per_key as (select txn_id, sum(l) as l, sum(r) as r,
                           max(amount) filter (l > 0) is distinct from max(amount) filter (r > 0) as of_amount,
                           max(channel) filter (l > 0) is distinct from max(channel) filter (r > 0) as of_channel
                    from per_row group by txn_id)
        select txn_id, case when r = 0 then 'only_left' when l = 0 then 'only_right' else 'changed' end as status,
               cast(l as bigint) as left_rows, cast(r as bigint) as right_rows,
               case when l = 1 and r = 1 then concat_ws(',', case when of_channel then 'channel' end,
                                                             case when of_amount then 'amount' end) end as columns
        from per_key"""

    for name in ORDER_REPORTS:
        out[f"orders_{name}"] = out[name].replace(_LEDGER, _ORDERS)
    for name in GAPPED_REPORTS:
        out[f"gapped_{name}"] = out[name].replace(_LEDGER, _GAPPED)
    return out
