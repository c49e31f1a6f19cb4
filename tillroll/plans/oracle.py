"""Independent DuckDB SQL for each registered query (the correctness oracle).

Each query is ``WITH <domain views> <body>``; the domain views restate the
mapping of ``tillroll.sources.tables`` in SQL over the driver's tables.
Column names equal the Spark results' names.
"""

from __future__ import annotations

# name -> (sql, dependencies)
CTES: dict[str, tuple[str, list[str]]] = {
    "ob": ("""SELECT o.o_orderkey, o.o_custkey, o.o_totalprice, o.o_orderdate,
              o.o_orderpriority, c.c_mktsegment AS branch
       FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey""", []),
    "monthly_sales": ("""SELECT branch, CAST(year(o_orderdate) AS INTEGER) AS year,
              CAST(month(o_orderdate) AS INTEGER) AS month_num,
              CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_sales
       FROM ob GROUP BY 1, 2, 3""", ["ob"]),
    "branch_revenue": ("""SELECT branch, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue FROM ob GROUP BY 1""",
                       ["ob"]),
    "menu_channels": ("""SELECT branch, o_orderpriority AS menu_channel,
              CAST(count(DISTINCT o_custkey) AS DOUBLE) AS num_customers,
              CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS sales
       FROM ob GROUP BY 1, 2""", ["ob"]),
    "lp": ("""SELECT l.l_orderkey, l.l_quantity, l.l_extendedprice, l.l_returnflag,
              p.p_name, p.p_brand,
              p.p_type, ob.branch
       FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
       JOIN ob ON l.l_orderkey = ob.o_orderkey""", ["ob"]),
    "delivery_lines": ("""SELECT branch, CAST(l_orderkey AS VARCHAR) AS customer,
              p_brand AS item, l_quantity AS qty, l_extendedprice AS price FROM lp""", ["lp"]),
    "item_sales": ("""SELECT branch, p_type AS division, p_brand AS grp, p_name AS item,
              l_quantity AS qty, l_extendedprice AS total_amount FROM lp""", ["lp"]),
    "attendance": ("""SELECT user_id AS employee_id, event_type AS branch,
              CAST(ts AS DATE) AS date, strftime(ts, '%H.%M.%S') AS punch_in,
              value AS work_hours
       FROM events""", []),
    # --- staffing -------------------------------------------------------------
    "att_s": ("""SELECT employee_id, branch, date, work_hours, punch_hour,
              CASE WHEN punch_hour IS NULL THEN 'Unknown'
                   WHEN punch_hour >= 6 AND punch_hour < 14 THEN 'Morning (06–14)'
                   WHEN punch_hour >= 14 AND punch_hour < 22 THEN 'Afternoon (14–22)'
                   ELSE 'Night (22–06)' END AS shift,
              dayname(date) AS day_of_week
       FROM (SELECT *, TRY_CAST(split_part(replace(trim(punch_in), '.', ':'), ':', 1)
                                AS BIGINT) AS punch_hour
             FROM attendance WHERE work_hours > 0.5)""", ["attendance"]),
    "daily": ("""SELECT branch, shift, date, day_of_week,
              count(DISTINCT employee_id) AS staff_count
       FROM att_s WHERE branch IS NOT NULL AND date IS NOT NULL
       GROUP BY 1, 2, 3, 4""", ["att_s"]),
    "shift_summary": ("""SELECT branch, shift, avg(staff_count) AS mean_staff,
              max(staff_count) AS max_staff, min(staff_count) AS min_staff,
              count(*) AS days_observed,
              CAST(least(ceil(avg(staff_count) * 1.15), max(staff_count)) AS INTEGER)
                AS recommended_staff
       FROM daily GROUP BY 1, 2""", ["daily"]),
    # --- demand ---------------------------------------------------------------
    "ser": ("""SELECT *, year * 100 + month_num AS period,
              row_number() OVER (PARTITION BY branch ORDER BY year, month_num) AS t
       FROM monthly_sales WHERE branch IS NOT NULL""", ["monthly_sales"]),
    "st": ("""SELECT branch, n_months, historical_mean, first_sales, last_sales, last_period,
              coalesce(slope, 0.0) AS slope, coalesce(intercept, historical_mean) AS intercept,
              CASE WHEN n_months > 1 AND first_sales > 0
                   THEN (last_sales - first_sales) / first_sales * 100 ELSE 0.0 END AS growth_pct
       FROM (SELECT branch, count(*) AS n_months, avg(total_sales) AS historical_mean,
                    arg_min(total_sales, period) AS first_sales,
                    arg_max(total_sales, period) AS last_sales,
                    max(period) AS last_period,
                    regr_slope(total_sales, t) AS slope,
                    regr_intercept(total_sales, t) AS intercept
             FROM ser GROUP BY branch)""", ["ser"]),
    "fc": ("""SELECT branch, step, n_months, historical_mean, target,
              greatest(intercept + slope * (n_months + step), 0.0) AS forecast
       FROM (SELECT st.*, CAST(s.step AS INTEGER) AS step,
                    make_date(CAST(last_period // 100 AS INTEGER),
                              CAST(last_period % 100 AS INTEGER), 1)
                      + to_months(CAST(s.step AS INTEGER)) AS target
             FROM st, (SELECT unnest(generate_series(1, 3)) AS step) s)""", ["st"]),
}


def with_(names: list[str], body: str) -> str:
    """``WITH`` clause holding ``names`` and their dependencies, then ``body``."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in CTES[n][1]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    parts = [f"{n} AS ({CTES[n][0]})" for n in order]
    if not parts:
        b = body.lstrip()
        return "WITH " + b[1:] if b.startswith(",") else body
    return "WITH " + ",\n".join(parts) + "\n" + body


ORACLE: dict[str, str] = {}


def oracle(name: str, ctes: list[str], body: str) -> None:
    ORACLE[name] = with_(ctes, body)


# --- staffing -----------------------------------------------------------------
oracle("shift_assign", ["att_s"], """SELECT employee_id, branch, date, punch_hour, shift,
       day_of_week FROM att_s""")
oracle("daily_headcount", ["daily"], "SELECT * FROM daily")
oracle("shift_staffing", ["shift_summary"], "SELECT * FROM shift_summary")
oracle("result_sink", ["shift_summary"], "SELECT * FROM shift_summary")
oracle("staffing_by_day", ["att_s"], """SELECT branch, day_of_week, shift,
       count(DISTINCT employee_id) AS distinct_staff
  FROM att_s WHERE branch IS NOT NULL GROUP BY 1, 2, 3""")
oracle("hours_by_branch", ["attendance"], """SELECT branch, avg(work_hours) AS avg_hours,
       CAST(median(work_hours) AS DOUBLE) AS median_hours, min(work_hours) AS min_hours,
       max(work_hours) AS max_hours, count(work_hours) AS shift_records
  FROM attendance WHERE work_hours > 0.5 AND branch IS NOT NULL GROUP BY 1""")
oracle("hours_histogram", ["attendance"], """, h AS (SELECT work_hours AS h FROM attendance
                                                   WHERE work_hours > 0.5),
  r AS (SELECT min(h) AS lo, max(h) AS hi FROM h),
  b AS (SELECT CAST(CASE WHEN hi - lo > 0
                    THEN least(floor((h - lo) * 30 / (hi - lo)), 29) ELSE 0 END AS INTEGER) AS bin,
               count(*) AS n
        FROM h, r GROUP BY 1),
  allb AS (SELECT CAST(unnest(generate_series(0, 29)) AS INTEGER) AS bin)
SELECT allb.bin, lo + (hi - lo) * allb.bin / 30 AS bin_start,
       lo + (hi - lo) * (allb.bin + 1) / 30 AS bin_end, coalesce(b.n, 0) AS n
  FROM allb CROSS JOIN r LEFT JOIN b ON allb.bin = b.bin""")
oracle("staffing_kpis", ["shift_summary"], """SELECT count(*) AS n_slots,
       CAST(coalesce(sum(recommended_staff), 0) AS BIGINT) AS total_recommended,
       count(*) FILTER (WHERE min_staff < 2) AS n_at_risk FROM shift_summary""")
oracle("staffing_alerts", ["shift_summary"], """SELECT branch, shift,
       format('{} – {}: recommend {} staff (observed range {}–{}, avg {:,.1f})',
              branch, shift, recommended_staff, min_staff, max_staff, mean_staff)
         AS recommendation,
       CASE WHEN min_staff < 2
            THEN format('ALERT: {} – {} had as few as {} staff on some days.',
                        branch, shift, min_staff) END AS alert
  FROM shift_summary""")

# --- demand -------------------------------------------------------------------
oracle("demand_growth", ["st"], """SELECT branch, n_months, historical_mean, growth_pct
  FROM st""")
oracle("demand_forecast", ["fc"], """SELECT branch, step,
       CAST(year(target) AS INTEGER) AS year, CAST(month(target) AS INTEGER) AS month_num,
       strftime(target, '%B %Y') AS period, forecast,
       forecast * 0.9 AS lower, forecast * 1.1 AS upper,
       (forecast - historical_mean) / greatest(historical_mean, 1.0) * 100 AS variance_pct
  FROM fc""")
_FORECAST = """SELECT branch, step,
       CAST(year(target) AS INTEGER) AS year, CAST(month(target) AS INTEGER) AS month_num,
       strftime(target, '%B %Y') AS period, forecast,
       forecast * 0.9 AS lower, forecast * 1.1 AS upper,
       (forecast - historical_mean) / greatest(historical_mean, 1.0) * 100 AS variance_pct,
       CAST(NULL AS VARCHAR) AS error
  FROM fc"""
oracle("forecast_branch", ["fc"], _FORECAST + " WHERE branch = 'BUILDING'")
oracle("forecast_branch_missing", ["fc"], f"""SELECT 'NO SUCH BRANCH' AS branch, * EXCLUDE (one, branch, error),
       'No data for this branch' AS error
  FROM (SELECT 1 AS one) LEFT JOIN ({_FORECAST}) ON branch = 'NO SUCH BRANCH'""")
oracle("demand_ranking", ["fc"], """SELECT branch, avg(round_even(forecast, 2)) AS avg_forecast
  FROM fc GROUP BY branch""")
oracle("demand_trend", ["st"], """SELECT branch, growth_pct,
       CASE WHEN growth_pct > 5 THEN 'growing' WHEN growth_pct < -5 THEN 'declining'
            ELSE 'stable' END AS trend,
       CASE WHEN growth_pct > 10 THEN 'Strong Growth' WHEN growth_pct > 3 THEN 'Moderate Growth'
            WHEN growth_pct > -3 THEN 'Stable' WHEN growth_pct > -10 THEN 'Moderate Decline'
            ELSE 'Sharp Decline' END AS trend_band
  FROM st""")


# --- segments -----------------------------------------------------------------
def _segment_case(col: str) -> str:
    from tillroll.sources import tables as tb

    def any_of(kws):
        return " OR ".join(f"contains(upper({col}), '{k}')" for k in kws)

    return (f"CASE WHEN {any_of(tb.PART_MILKSHAKE_KEYWORDS)} THEN 'milkshake' "
            f"WHEN {any_of(tb.PART_COFFEE_KEYWORDS)} THEN 'coffee' "
            f"WHEN {any_of(tb.PART_CHIMNEY_KEYWORDS)} THEN 'chimney_cake' ELSE 'other' END")


CTES.update({
    "seg": (f"SELECT *, {_segment_case('item')} AS segment FROM item_sales", ["item_sales"]),
    "share": ("""SELECT branch, segment, segment_revenue, branch_total,
              CASE WHEN branch_total <> 0 THEN segment_revenue / branch_total * 100 END AS share_pct
       FROM (SELECT *, CAST(sum(CAST(segment_revenue AS DECIMAL(38,2)))
                             OVER (PARTITION BY branch) AS DOUBLE) AS branch_total
             FROM (SELECT branch, segment, CAST(sum(CAST(total_amount AS DECIMAL(18,2))) AS DOUBLE) AS segment_revenue
                   FROM seg WHERE branch IS NOT NULL GROUP BY 1, 2))""", ["seg"]),
})

oracle("segment_classify", ["seg"], "SELECT DISTINCT item, segment FROM seg")
oracle("segment_share", ["share"], "SELECT * FROM share")
oracle("top_segment_items", ["seg"], """SELECT * FROM (
  (SELECT item, sum(qty) AS total_qty, CAST(sum(CAST(total_amount AS DECIMAL(18,2))) AS DOUBLE) AS total_revenue, 'coffee' AS segment
     FROM seg WHERE segment = 'coffee' GROUP BY item ORDER BY total_revenue DESC, item LIMIT 10)
  UNION ALL
  (SELECT item, sum(qty) AS total_qty, CAST(sum(CAST(total_amount AS DECIMAL(18,2))) AS DOUBLE) AS total_revenue, 'milkshake' AS segment
     FROM seg WHERE segment = 'milkshake' GROUP BY item ORDER BY total_revenue DESC, item LIMIT 10))""")
oracle("segment_comparison", ["seg"], """SELECT branch, segment, sum(qty) AS total_qty,
       CAST(sum(CAST(total_amount AS DECIMAL(18,2))) AS DOUBLE) AS total_revenue
  FROM seg WHERE segment IN ('coffee', 'milkshake') AND branch IS NOT NULL GROUP BY 1, 2""")
oracle("segment_totals", ["seg"], """SELECT *, coffee_total_revenue / greatest(total_revenue, 1.0) * 100
         AS coffee_share_pct,
       milkshake_total_revenue / greatest(total_revenue, 1.0) * 100 AS milkshake_share_pct
  FROM (SELECT coalesce(CAST(sum(CAST(CASE WHEN segment = 'coffee' THEN total_amount END AS DECIMAL(18,2))) AS DOUBLE), 0.0)
                 AS coffee_total_revenue,
               coalesce(CAST(sum(CAST(CASE WHEN segment = 'milkshake' THEN total_amount END AS DECIMAL(18,2))) AS DOUBLE), 0.0)
                 AS milkshake_total_revenue,
               coalesce(CAST(sum(CAST(total_amount AS DECIMAL(18,2))) AS DOUBLE), 0.0) AS total_revenue FROM seg)""")
oracle("segment_pivot", ["share"], """SELECT branch,
       coalesce(max(CASE WHEN segment = 'coffee' THEN share_pct END), 0.0) AS coffee,
       coalesce(max(CASE WHEN segment = 'milkshake' THEN share_pct END), 0.0) AS milkshake,
       coalesce(max(CASE WHEN segment = 'chimney_cake' THEN share_pct END), 0.0) AS chimney_cake,
       coalesce(max(CASE WHEN segment = 'other' THEN share_pct END), 0.0) AS other
  FROM share GROUP BY branch""")
oracle("segment_performance", ["share"], """SELECT branch, segment, share_pct, threshold_pct,
       CASE WHEN share_pct < threshold_pct THEN 'underperforming' ELSE 'performing' END AS status
  FROM (SELECT branch, segment, round_even(share_pct, 2) AS share_pct,
               CASE segment WHEN 'coffee' THEN 20.0::DOUBLE ELSE 10.0::DOUBLE END AS threshold_pct
        FROM share WHERE segment IN ('coffee', 'milkshake'))""")
oracle("beverage_gap", ["share"], """SELECT branch, bev AS beverage_share_pct,
       greatest(35.0::DOUBLE - bev, 0.0) AS gap_pct,
       CASE WHEN bev >= 35.0 THEN 'green' WHEN bev >= 0.7::DOUBLE * 35.0::DOUBLE THEN 'amber'
            ELSE 'red' END AS status
  FROM (SELECT branch, sum(round_even(share_pct, 2)) AS bev FROM share
        WHERE segment IN ('coffee', 'milkshake') GROUP BY branch)""")
oracle("beverage_gap_network", ["seg"], """SELECT bev AS beverage_share_pct, greatest(35.0::DOUBLE - bev, 0.0) AS gap_pct,
       CASE WHEN bev >= 35.0 THEN 'green' WHEN bev >= 0.7::DOUBLE * 35.0::DOUBLE THEN 'amber' ELSE 'red' END AS status,
       CASE WHEN bev >= 35.0 THEN format('Beverage revenue at {:.1f}% meets the 35% benchmark.', bev)
            WHEN bev >= 0.7::DOUBLE * 35.0::DOUBLE
            THEN format('Beverage revenue at {:.1f}% is below the 35% industry benchmark. A {:.1f}pp improvement would '
                        || 'reach best-in-class.', bev, greatest(35.0::DOUBLE - bev, 0.0))
            ELSE format('Beverage revenue at {:.1f}% is significantly below the 35% benchmark. This represents a major '
                        || 'untapped revenue opportunity.', bev) END AS finding
  FROM (SELECT round_even(100 * coffee / greatest(total, 1.0), 2) + round_even(100 * shake / greatest(total, 1.0), 2) AS bev
        FROM (SELECT CAST(coalesce(sum(CAST(total_amount AS DECIMAL(18,2))) FILTER (segment = 'coffee'), 0) AS DOUBLE) AS coffee,
                     CAST(coalesce(sum(CAST(total_amount AS DECIMAL(18,2))) FILTER (segment = 'milkshake'), 0) AS DOUBLE) AS shake,
                     CAST(coalesce(sum(CAST(total_amount AS DECIMAL(18,2))), 0) AS DOUBLE) AS total FROM seg))""")
CTES["star"] = ("""SELECT item, sum(CAST(total_amount AS DECIMAL(18,2))) AS rev FROM seg WHERE segment = 'coffee'
       GROUP BY item ORDER BY rev DESC, item LIMIT 1""", ["seg"])
CTES["gactions"] = ("""SELECT CAST(rank AS INTEGER) AS rank, strategy, target,
              CASE rank WHEN 1 THEN 'IMMEDIATE' WHEN 2 THEN 'IMMEDIATE' WHEN 3 THEN 'THIS MONTH'
                        WHEN 4 THEN 'THIS QUARTER' WHEN 5 THEN 'THIS QUARTER'
                        ELSE 'PLANNED' END AS priority, action, expected_impact
       FROM (SELECT *, row_number() OVER (ORDER BY ordinal) AS rank FROM (
               SELECT 1 AS ordinal, 'Star Product Upsell' AS strategy, 'coffee' AS target,
                      (SELECT count(*) > 0 FROM star) AS fired,
                      (SELECT format('Feature ''{}'' prominently in menus and POS upsell prompts. It generates {:,.0f} units '
                                     || 'revenue — train staff to recommend it.', item, rev::DOUBLE) FROM star) AS action,
                      '5–10% increase in coffee revenue per upsell conversion' AS expected_impact
               UNION ALL SELECT 2, 'Coffee + Chimney Cake Combo Bundle', 'coffee + chimney_cake', true,
                      'Create a ''Coffee & Chimney'' combo at a 5–8% discount vs. buying separately. '
                      || 'Cross-sell at POS when a chimney cake is ordered.',
                      'Increases average basket size by ~15% and coffee attach rate'
               UNION ALL SELECT 3, 'Branch-Level Coffee Drive',
                      'Branches: ' || array_to_string(u.under_coffee, ', '),
                      coalesce(len(u.under_coffee) > 0, false),
                      'These branches have <20% coffee revenue share. Run a 2-week ''Coffee Month'' promo with discounts on '
                      || 'new coffee SKUs, loyalty stamps, and barista spotlight content on social media.',
                      '+3–5% coffee revenue share per branch within 1 month'
                 FROM (SELECT list_sort(list(branch)) AS under_coffee FROM share
                       WHERE segment = 'coffee' AND round_even(share_pct, 2) < 20) u
               UNION ALL SELECT 4, 'Seasonal Milkshake Menu', 'milkshake',
                      (SELECT coalesce(bool_or(segment = 'milkshake'), false) FROM seg),
                      'Introduce 2–3 rotating seasonal milkshake flavours (e.g. rose, pistachio) as limited-edition items. '
                      || 'Use scarcity marketing (Instagram stories, countdown).',
                      '10–20% milkshake volume uplift during campaign period'
               UNION ALL SELECT 5, 'Off-Peak Happy Hour', 'coffee + milkshake', true,
                      'Offer 20% off coffee & milkshakes Mon–Thu 14:00–17:00. Converts low-traffic afternoon hours into '
                      || 'revenue opportunities.',
                      '15–25% increase in afternoon transaction volume')
             WHERE fired)""", ["seg", "share", "star"])
oracle("growth_actions", ["gactions"], "SELECT * FROM gactions")


# --- branches / expansion -----------------------------------------------------
from tillroll.sources.tables import DRIVER_CHANNELS as _CHANNELS  # noqa: E402


def _suffix(v: str) -> str:
    from tillroll.functions.scalar import column_suffix
    return column_suffix(v)


_sales_cols = ", ".join(
    f"coalesce(CAST(sum(CAST(sales AS DECIMAL(18,2))) FILTER (WHERE menu_channel = '{c}') "
    f"AS DOUBLE), 0.0) AS sales_{_suffix(c)}"
    for c in _CHANNELS)
_total = "greatest(sales_all, 1.0)"
_pct_cols = ", ".join(f"sales_{_suffix(c)} / {_total} * 100 AS pct_{_suffix(c)}"
                      for c in _CHANNELS)

CTES.update({
    "bg": ("""SELECT branch, n_months,
              CASE WHEN n_months >= 2 AND first_sales > 0
                   THEN (pow(last_sales / first_sales, 1.0 / greatest(n_months - 1, 1)) - 1) * 100
                   ELSE 0.0 END AS monthly_growth_pct
       FROM (SELECT branch, count(*) AS n_months,
                    arg_min(total_sales, year * 100 + month_num) AS first_sales,
                    arg_max(total_sales, year * 100 + month_num) AS last_sales
             FROM monthly_sales WHERE branch IS NOT NULL GROUP BY branch)""", ["monthly_sales"]),
    "mix": (f"""SELECT branch, {', '.join('sales_' + _suffix(c) for c in _CHANNELS)}, {_pct_cols}
       FROM (SELECT branch, CAST(sum(CAST(sales AS DECIMAL(18,2))) AS DOUBLE) AS sales_all, {_sales_cols} FROM menu_channels WHERE branch IS NOT NULL
             GROUP BY branch)""", ["menu_channels"]),
    "kpis": (f"""SELECT b.branch, coalesce(total_revenue, 0.0) AS total_revenue,
              CASE WHEN coalesce(network_revenue, 0.0) <> 0
                   THEN round_even(coalesce(total_revenue, 0.0) / network_revenue * 100, 2)
                   ELSE 0.0 END AS revenue_share_pct,
              round_even(coalesce(monthly_growth_pct, 0.0), 2) AS monthly_growth_pct,
              coalesce(CAST(nc AS BIGINT), 0) AS num_customers,
              coalesce(round_even(avg_spend, 2), 0.0) AS avg_spend,
              {', '.join(f'coalesce(round_even(pct_{_suffix(c)}, 1), 0.0) AS pct_{_suffix(c)}'
                         for c in _CHANNELS)}
       FROM (SELECT coalesce(rev.branch, bg.branch) AS branch, total_revenue, monthly_growth_pct
             FROM (SELECT branch, CAST(sum(CAST(revenue AS DECIMAL(18,2))) AS DOUBLE) AS total_revenue FROM branch_revenue
                   WHERE branch IS NOT NULL GROUP BY 1) rev
             FULL OUTER JOIN bg ON rev.branch = bg.branch) b
       LEFT JOIN (SELECT branch, sum(num_customers) AS nc,
                         CAST(sum(CAST(sales AS DECIMAL(18,2))) AS DOUBLE) / greatest(sum(num_customers), 1.0) AS avg_spend
                  FROM menu_channels WHERE branch IS NOT NULL GROUP BY 1) cu
              ON b.branch = cu.branch
       LEFT JOIN mix ON b.branch = mix.branch
       CROSS JOIN (SELECT CAST(sum(CAST(total_revenue AS DECIMAL(18,2))) AS DOUBLE) AS network_revenue
                   FROM (SELECT branch, CAST(sum(CAST(revenue AS DECIMAL(18,2))) AS DOUBLE) AS total_revenue FROM branch_revenue
                         WHERE branch IS NOT NULL GROUP BY 1)) net""", ["bg", "mix", "branch_revenue"]),
    "signals": ("""SELECT *, growing_network::INTEGER + saturated_branch_present::INTEGER
                   + high_customer_density::INTEGER AS signal_score,
              CASE WHEN growing_network::INTEGER + saturated_branch_present::INTEGER
                        + high_customer_density::INTEGER >= 2
                   THEN 'RECOMMENDED' ELSE 'NOT RECOMMENDED' END AS feasibility
       FROM (SELECT *, avg_monthly_growth_pct > 1.0 AS growing_network,
                    max_share_pct > 40.0 AS saturated_branch_present,
                    total_customers > 500 AS high_customer_density
             FROM (SELECT sum(total_revenue) AS total_revenue,
                          CAST(sum(num_customers) AS BIGINT) AS total_customers,
                          avg(monthly_growth_pct) AS avg_monthly_growth_pct,
                          max(revenue_share_pct) AS max_share_pct,
                          arg_min(branch, (-revenue_share_pct, branch)) AS saturated_branch,
                          count(*) AS n_branches FROM kpis))""", ["kpis"]),
    "cand": ("""SELECT location, 0.5 + pos_share AS growth_factor,
              60.0 + 40.0 * coalesce(n_cust / CASE WHEN max_cust > 0 THEN max_cust END, 0.0)
                AS demand_base,
              20.0 + 40.0 * coalesce(n_supp / CASE WHEN max_supp > 0 THEN max_supp END, 0.0)
                AS competition_risk
       FROM (SELECT n_name AS location, coalesce(n_cust, 0) AS n_cust,
                    coalesce(n_supp, 0) AS n_supp, coalesce(pos_share, 0.0) AS pos_share
             FROM nation
             LEFT JOIN (SELECT c_nationkey, count(*) AS n_cust,
                               avg(CASE WHEN c_acctbal > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)
                                 AS pos_share
                        FROM customer GROUP BY 1) c ON n_nationkey = c.c_nationkey
             LEFT JOIN (SELECT s_nationkey, count(*) AS n_supp FROM supplier GROUP BY 1) s
                    ON n_nationkey = s.s_nationkey) per,
            (SELECT max(coalesce(n_cust, 0)) AS max_cust, max(coalesce(n_supp, 0)) AS max_supp
             FROM nation
             LEFT JOIN (SELECT c_nationkey, count(*) AS n_cust FROM customer GROUP BY 1) c
                    ON n_nationkey = c.c_nationkey
             LEFT JOIN (SELECT s_nationkey, count(*) AS n_supp FROM supplier GROUP BY 1) s
                    ON n_nationkey = s.s_nationkey) mx""", []),
})

oracle("branch_growth", ["bg"], "SELECT * FROM bg")
oracle("channel_mix", ["mix"], "SELECT * FROM mix")
oracle("branch_kpis", ["kpis"], "SELECT * FROM kpis")
oracle("expansion_signals", ["signals"], "SELECT * FROM signals")
oracle("score_candidates", ["cand", "signals"], """SELECT location,
       demand_base * (1 + avg_monthly_growth_pct / 100) AS demand_score, competition_risk,
       demand_base * (1 + avg_monthly_growth_pct / 100) * growth_factor
         - competition_risk * 0.3 AS composite_score
  FROM cand CROSS JOIN (SELECT avg_monthly_growth_pct FROM signals) g""")


# --- baskets --------------------------------------------------------------------
CTES.update({
    "bk": ("""SELECT branch, customer, item, sum(qty) AS q
       FROM (SELECT branch, customer, upper(trim(item)) AS item, qty FROM delivery_lines
             WHERE price > 0)
       WHERE item NOT IN ('DELIVERY CHARGE', 'SERVICE CHARGE')
         AND branch IS NOT NULL AND customer IS NOT NULL AND item IS NOT NULL
       GROUP BY 1, 2, 3""", ["delivery_lines"]),
    "bsk": ("""SELECT branch, customer,
              coalesce(list_sort(list(item) FILTER (WHERE q <> 0)), []) AS items
       FROM bk GROUP BY 1, 2""", ["bk"]),
    "bi": ("""SELECT branch || chr(31) || customer AS bid, item FROM bk WHERE q <> 0""", ["bk"]),
    "nb": ("""SELECT count(*) AS n_baskets FROM bsk""", ["bsk"]),
    "single": ("""SELECT item, count(*) AS cnt FROM bi GROUP BY 1""", ["bi"]),
    "pairs": ("""SELECT a AS antecedents, b AS consequents, both_ / n_baskets AS support,
       greatest(both_ / greatest(cnt_a, 1), both_ / greatest(cnt_b, 1)) AS confidence,
       (both_ / greatest(cnt_a, 1)) / greatest(cnt_b / n_baskets, 1e-9) AS lift
  FROM (SELECT x.item AS a, y.item AS b, count(*) AS both_
        FROM bi x JOIN bi y ON x.bid = y.bid AND x.item < y.item GROUP BY 1, 2) p
  JOIN (SELECT item, cnt AS cnt_a FROM single) sa ON p.a = sa.item
  JOIN (SELECT item, cnt AS cnt_b FROM single) sb ON p.b = sb.item
  CROSS JOIN nb
  ORDER BY support DESC, antecedents, consequents LIMIT 20""", ["bi", "single", "nb"]),
})


def _mining(prefix: str, support: float, confidence: float, bi: str = "bi", nb: str = "nb",
            lift: float = 1.0) -> None:
    """CTEs of itemsets of up to three items and their rules; itemsets are lists of items."""
    enough = f"HAVING count(*) >= {support}::DOUBLE * (SELECT n_baskets FROM {nb})"
    p = prefix
    CTES.update({
        f"{p}f1": (f"SELECT item AS i1, count(*) AS c FROM {bi} GROUP BY 1 {enough}", [bi, nb]),
        f"{p}f2": (f"""SELECT a.item AS i1, b.item AS i2, count(*) AS c
       FROM {bi} a JOIN {bi} b ON a.bid = b.bid AND a.item < b.item
       WHERE a.item IN (SELECT i1 FROM {p}f1) AND b.item IN (SELECT i1 FROM {p}f1)
       GROUP BY 1, 2 {enough}""", [bi, f"{p}f1"]),
        f"{p}f3": (f"""SELECT a.item AS i1, b.item AS i2, c.item AS i3, count(*) AS c
       FROM {bi} a JOIN {bi} b ON a.bid = b.bid AND a.item < b.item
                 JOIN {bi} c ON b.bid = c.bid AND b.item < c.item
       WHERE a.item IN (SELECT i1 FROM {p}f1) AND b.item IN (SELECT i1 FROM {p}f1)
         AND c.item IN (SELECT i1 FROM {p}f1)
       GROUP BY 1, 2, 3 {enough}""", [bi, f"{p}f1"]),
        f"{p}fis": (f"""SELECT itemset, size, freq, freq / (SELECT n_baskets FROM {nb}) AS support FROM (
         SELECT [i1] AS itemset, 1 AS size, c AS freq FROM {p}f1
         UNION ALL SELECT [i1, i2], 2, c FROM {p}f2
         UNION ALL SELECT [i1, i2, i3], 3, c FROM {p}f3)""", [f"{p}f1", f"{p}f2", f"{p}f3"]),
        f"{p}splits": (f"""SELECT [i1] AS antecedents, [i2] AS consequents, c FROM {p}f2
       UNION ALL SELECT [i2], [i1], c FROM {p}f2
       UNION ALL SELECT [i1], [i2, i3], c FROM {p}f3
       UNION ALL SELECT [i2], [i1, i3], c FROM {p}f3
       UNION ALL SELECT [i3], [i1, i2], c FROM {p}f3
       UNION ALL SELECT [i1, i2], [i3], c FROM {p}f3
       UNION ALL SELECT [i1, i3], [i2], c FROM {p}f3
       UNION ALL SELECT [i2, i3], [i1], c FROM {p}f3""", [f"{p}f2", f"{p}f3"]),
        f"{p}rules": (f"""SELECT array_to_string(antecedents, ', ') AS antecedents,
              array_to_string(consequents, ', ') AS consequents, support, confidence, lift, leverage, conviction
       FROM (SELECT *, confidence / consequent_support AS lift,
                    support - antecedent_support * consequent_support AS leverage,
                    CASE WHEN confidence = 1 THEN 'inf'::DOUBLE
                         ELSE (1 - consequent_support) / (1 - confidence) END AS conviction
             FROM (SELECT s.antecedents, s.consequents,
                          s.c / (SELECT n_baskets FROM {nb}) AS support,
                          fa.support AS antecedent_support, fc.support AS consequent_support,
                          (s.c / (SELECT n_baskets FROM {nb})) / fa.support AS confidence
                   FROM {p}splits s JOIN {p}fis fa ON s.antecedents = fa.itemset
                                 JOIN {p}fis fc ON s.consequents = fc.itemset))
       WHERE lift >= {lift} AND confidence >= {confidence}""", [f"{p}splits", f"{p}fis"]),
    })


_mining("", 0.02, 0.1)
# baskets of return flags: three items, so no itemset is longer than the SQL goes
CTES.update({
    "t_bi": ("SELECT DISTINCT l_orderkey AS bid, l_returnflag AS item FROM lineitem WHERE l_extendedprice > 0", []),
    "t_nb": ("SELECT count(DISTINCT bid) AS n_baskets FROM t_bi", ["t_bi"]),
})
_mining("t_", 0.02, 0.1, "t_bi", "t_nb", 0.1)
CTES.update({
    "combos": ("""SELECT antecedents || ' + ' || consequents AS items, antecedents, consequents,
              round_even(support, 4) AS support, round_even(confidence, 4) AS confidence,
              round_even(lift, 4) AS lift
       FROM (SELECT * FROM rules WHERE (SELECT n_baskets FROM nb) >= 5
             ORDER BY rules.lift DESC, antecedents, consequents LIMIT 10)""", ["rules", "nb"]),
})

oracle("baskets", ["bsk"], """SELECT branch, customer, array_to_string(items, ', ') AS items,
       CAST(len(items) AS INTEGER) AS n_items FROM bsk""")
oracle("item_frequency", ["single", "nb"], """SELECT item, cnt AS n_baskets_with_item,
       cnt / (SELECT n_baskets FROM nb) AS support FROM single""")
oracle("basket_stats", ["bsk", "bi"], """SELECT n_baskets, nnz, n_items,
       CASE WHEN n_baskets * n_items > 0 THEN 1 - nnz / (n_baskets * n_items) END AS sparsity
  FROM (SELECT count(*) AS n_baskets, CAST(coalesce(sum(len(items)), 0) AS BIGINT) AS nnz
        FROM bsk), (SELECT count(DISTINCT item) AS n_items FROM bi)""")
oracle("frequent_itemsets", ["fis"], """SELECT array_to_string(itemset, ', ') AS itemset, size, freq, support
  FROM fis""")
oracle("association_rules", ["rules"], "SELECT * FROM rules")
oracle("association_rules_triples", ["t_rules"], "SELECT * FROM t_rules")
oracle("combo_top", ["combos"], """SELECT *,
       CASE WHEN lift > 3 THEN 'very strong' WHEN lift > 2 THEN 'strong'
            WHEN lift > 1.5 THEN 'moderate' ELSE 'present' END AS strength,
       CASE WHEN lift >= 2 THEN 'HIGH' ELSE 'MEDIUM' END AS priority,
       format('Bundle ''{}'' — {:,.0f}% of customers who buy one also buy the other (lift {:,.2f}x)',
              items, confidence * 100, lift) AS recommendation
  FROM combos""")
_BUNDLE = """format('Bundle ''{}'' — {:,.0f}% of customers who buy one also buy the other (lift {:,.2f}x)',
              items, confidence * 100, lift)"""
_SINGLE = """SELECT 'top_single_items' AS method, item AS items, CAST(NULL AS DOUBLE) AS support,
       CAST(NULL AS DOUBLE) AS confidence, CAST(NULL AS DOUBLE) AS lift, qty,
       format('Promote {} as a featured item (sold {:.0f} units)', item, qty) AS recommendation
  FROM (SELECT upper(trim(item)) AS item, sum(qty) AS qty FROM delivery_lines
        WHERE price > 0 AND item IS NOT NULL GROUP BY 1 ORDER BY qty DESC, 1 LIMIT 10)"""
oracle("combo_summary", ["combos", "delivery_lines"], f"""SELECT 'apriori' AS method, items, support, confidence, lift,
       CAST(NULL AS DOUBLE) AS qty, {_BUNDLE} AS recommendation
  FROM combos
UNION ALL
SELECT * FROM ({_SINGLE}) WHERE (SELECT count(*) FROM combos) = 0""")
oracle("combo_summary_pairs", ["pairs"], f"""SELECT 'apriori' AS method, items, support, confidence, lift,
       CAST(NULL AS DOUBLE) AS qty, {_BUNDLE} AS recommendation
  FROM (SELECT antecedents || ' + ' || consequents AS items, round_even(support, 4) AS support,
               round_even(confidence, 4) AS confidence, round_even(lift, 4) AS lift
        FROM (SELECT * FROM pairs ORDER BY pairs.support DESC, antecedents, consequents LIMIT 10))""")
oracle("combo_summary_single", ["delivery_lines"], _SINGLE)
oracle("combo_kpis", ["combos"], """SELECT count(*) AS n_rules,
       count(*) FILTER (WHERE lift >= 2) AS n_strong, max(lift) AS max_lift,
       avg(confidence) AS mean_confidence,
       CASE WHEN count(*) > 0 THEN count(*) FILTER (WHERE lift >= 2) / count(*) * 100
            ELSE 0.0 END AS strong_share_pct
  FROM combos""")
oracle("item_pairs", ["pairs"], "SELECT * FROM pairs")
oracle("top_items_by_qty", ["delivery_lines"], """SELECT item, qty,
       format('Promote {} as a featured item (sold {:.0f} units)', item, qty) AS recommendation
  FROM (SELECT upper(trim(item)) AS item, sum(qty) AS qty FROM delivery_lines
        WHERE price > 0 AND item IS NOT NULL GROUP BY 1 ORDER BY qty DESC, item LIMIT 10)""")
oracle("top_items_by_revenue", ["item_sales"], """SELECT item, CAST(sum(CAST(total_amount AS DECIMAL(18,2))) AS DOUBLE) AS total_revenue,
       sum(qty) AS total_qty FROM item_sales WHERE item IS NOT NULL
  GROUP BY item ORDER BY total_revenue DESC, item LIMIT 20""")


# --- report primitives over driver data ---------------------------------------
oracle("clean_number", [], """, x AS (SELECT 1) SELECT l_orderkey, l_linenumber,
       format('{:,.2f}', l_extendedprice) AS price_text,
       CAST(replace(format('{:,.2f}', l_extendedprice), ',', '') AS DOUBLE) AS price,
       CASE WHEN l_discount = 0 THEN '-' ELSE '"' || format('{:,.2f}', l_discount) || '"' END
         AS discount_text,
       CASE WHEN l_discount = 0 THEN 0.0::DOUBLE
            ELSE CAST(format('{:.2f}', l_discount) AS DOUBLE) END AS discount
  FROM lineitem""")
oracle("duration_hours", [], """, x AS (SELECT 1) SELECT event_id,
       strftime(ts, '%H.%M.%S') AS clock_text,
       hour(ts) + minute(ts) / 60.0::DOUBLE + second(ts) / 3600.0::DOUBLE AS clock_hours,
       format('{}:{:02d}:{:02d}', h, m, s) AS span_text,
       h + m / 60.0::DOUBLE + s / 3600.0::DOUBLE AS span_hours
  FROM (SELECT event_id, ts, CAST(floor(value) AS BIGINT) AS h,
               CAST(floor(value * 60) AS BIGINT) % 60 AS m,
               CAST(floor(value * 3600) AS BIGINT) % 60 AS s FROM events)""")
oracle("compact_cells", [], """, x AS (SELECT 1) SELECT o_orderkey, CAST(3 AS INTEGER) AS n_cells,
       o_orderpriority || '|' || format('{:,.2f}', o_totalprice) || '|' || o_orderstatus AS cells
  FROM orders""")
_FOOT = r"(?i)Copyright|omegapos|Page \d+ of"
oracle("drop_boilerplate", [], f""", x AS (SELECT 1) SELECT conv_id, turn FROM conversations
 WHERE NOT (coalesce(regexp_matches(role, '{_FOOT}'), false)
            OR coalesce(regexp_matches(text, '{_FOOT}'), false))
   AND NOT (contains(lower(concat_ws(' ', role, text)), 'page')
            OR contains(lower(concat_ws(' ', role, text)), 'total'))""")
oracle("forward_fill_context", [], """, lines AS (
    SELECT c.c_mktsegment AS branch, o.o_custkey AS ck, l.l_orderkey, l.l_linenumber,
           NULL::VARCHAR AS ctx
      FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
      JOIN customer c ON o.o_custkey = c.c_custkey
    UNION ALL
    SELECT c_mktsegment, c_custkey, -1, -1, c_name FROM customer WHERE c_acctbal > 0)
SELECT branch, l_orderkey, l_linenumber, customer
  FROM (SELECT *, last_value(ctx IGNORE NULLS) OVER (
                    PARTITION BY branch ORDER BY ck, l_orderkey, l_linenumber
                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS customer
        FROM lines)
 WHERE l_orderkey >= 0""")

# fixed values: the driver's table schemas, in column order
_SCHEMAS = {
    "region": "r_regionkey, r_name",
    "nation": "n_nationkey, n_name, n_regionkey",
    "customer": "c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment",
    "supplier": "s_suppkey, s_name, s_nationkey, s_acctbal",
    "part": "p_partkey, p_name, p_brand, p_type, p_size, p_retailprice",
    "orders": "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority",
    "lineitem": "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, "
                "l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate",
    "events": "event_id, ts, user_id, event_type, value, props",
    "documents": "doc_id, text, lang, source, n_chars",
    "embeddings": "vec_id, embedding, label",
    "pages": "page_id, url, html",
    "benchmark": "item_id, text",
    "labels": "doc_id, quality, toxic",
    "conversations": "conv_id, turn, role, text",
}
oracle("dataset_profile", [], ", x AS (SELECT 1) " + "\nUNION ALL ".join(
    f"SELECT '{t}' AS dataset, count(*) AS n_rows, "
    f"CAST({len(cols.split(', '))} AS INTEGER) AS n_columns, '{cols}' AS columns FROM {t}"
    for t, cols in _SCHEMAS.items()))


# --- topics ---------------------------------------------------------------------
def _topic_select(text: str) -> str:
    from tillroll.functions.constants import TOPIC_KEYWORDS
    scores = []
    for name, kws in TOPIC_KEYWORDS.items():
        terms = " + ".join(f"(CASE WHEN contains(lower({text}), '{k}') THEN 1 ELSE 0 END)"
                           for k in kws)
        scores.append(f"CAST({terms} AS INTEGER) AS score_{name}")
    names = list(TOPIC_KEYWORDS)
    best = "greatest(" + ", ".join(f"score_{n}" for n in names) + ")"
    case = f"CASE WHEN {best} = 0 THEN 'overview' " + " ".join(
        f"WHEN score_{n} = {best} THEN '{n}'" for n in names) + " END AS topic"
    return ", ".join(scores), case


_tsc, _tcase = _topic_select("text")
oracle("topic_classify", [], f""", x AS (SELECT 1)
SELECT *, {_tcase} FROM (SELECT conv_id, turn, {_tsc} FROM conversations)""")
oracle("topic_classify_documents", [], f""", x AS (SELECT 1)
SELECT *, {_tcase} FROM (SELECT doc_id, {_tsc} FROM documents)""")
oracle("topic_counts", [], f""", x AS (SELECT 1)
SELECT topic, count(*) AS n FROM (SELECT *, {_tcase} FROM (SELECT {_tsc} FROM conversations))
 GROUP BY topic""")


# --- text reports and overview ----------------------------------------------------
oracle("demand_insight", ["st", "fc"], """SELECT st.branch,
       format('{} shows a {} trend ({:+.1f}% over the data period). '
              || 'Next {} months avg projected demand: {:,.0f} units.',
              st.branch, CASE WHEN growth_pct > 5 THEN 'growing'
                              WHEN growth_pct < -5 THEN 'declining' ELSE 'stable' END,
              growth_pct, 3, avg_forecast) AS insight
  FROM st JOIN (SELECT branch, avg(round_even(forecast, 2)) AS avg_forecast FROM fc
                GROUP BY branch) r ON st.branch = r.branch""")
oracle("network_overview", ["fc", "st", "signals", "cand", "shift_summary", "seg", "rules",
                            "gactions"], """,
  rk AS (SELECT branch, avg(round_even(forecast, 2)) AS avg_forecast FROM fc GROUP BY branch),
  dem AS (SELECT arg_max(branch, avg_forecast) AS top_branch,
                 arg_min(branch, avg_forecast) AS bottom_branch,
                 (max(avg_forecast) - min(avg_forecast)) / greatest(min(avg_forecast), 1.0) * 100
                   AS demand_spread_pct FROM rk),
  sg AS (SELECT feasibility,
                CASE WHEN avg_monthly_growth_pct > 3 THEN 'strong'
                     WHEN avg_monthly_growth_pct > 1 THEN 'moderate'
                     WHEN avg_monthly_growth_pct > 0 THEN 'slow' ELSE 'negative' END
                  AS network_growth FROM signals),
  best AS (SELECT arg_max(location, demand_base * (1 + g / 100) * growth_factor
                                    - competition_risk * 0.3) AS top_location
           FROM cand, (SELECT avg_monthly_growth_pct AS g FROM signals)),
  stf AS (SELECT count(*) FILTER (WHERE min_staff < 2) AS n_staff_alerts FROM shift_summary),
  tot AS (SELECT coffee_share_pct, milkshake_share_pct,
                 CASE WHEN bev >= 35.0 THEN 'green' WHEN bev >= 0.7::DOUBLE * 35.0::DOUBLE
                      THEN 'amber' ELSE 'red' END AS beverage_status
          FROM (SELECT *, round_even(coffee_share_pct, 2) + round_even(milkshake_share_pct, 2)
                          AS bev
                FROM (SELECT c / greatest(a, 1.0) * 100 AS coffee_share_pct,
                             m / greatest(a, 1.0) * 100 AS milkshake_share_pct
                      FROM (SELECT coalesce(CAST(sum(CAST(CASE WHEN segment = 'coffee' THEN total_amount END AS DECIMAL(18,2))) AS DOUBLE),
                                            0.0) AS c,
                                   coalesce(CAST(sum(CAST(CASE WHEN segment = 'milkshake' THEN total_amount END AS DECIMAL(18,2))) AS DOUBLE),
                                            0.0) AS m,
                                   coalesce(CAST(sum(CAST(total_amount AS DECIMAL(18,2))) AS DOUBLE), 0.0) AS a FROM seg)))),
  nr AS (SELECT count(*) AS n_rules FROM rules),
  cb AS (SELECT antecedents || ' + ' || consequents AS top_combo FROM rules
         ORDER BY lift DESC, antecedents, consequents LIMIT 1),
  c3 AS (SELECT string_agg(antecedents || ' + ' || consequents, ' | '
                           ORDER BY lift DESC, antecedents, consequents) AS top_combos
         FROM (SELECT * FROM rules ORDER BY lift DESC, antecedents, consequents LIMIT 3)),
  ga AS (SELECT string_agg(strategy, '; ' ORDER BY rank) AS actions FROM gactions),
  wd AS (SELECT arg_min(branch, growth_pct) AS worst_declining_branch FROM st
         WHERE growth_pct < -5)
SELECT * FROM dem, sg, best, stf, tot, nr, c3, ga, wd LEFT JOIN cb ON true""")


# --- remaining report pieces ----------------------------------------------------
oracle("top_slots", ["shift_summary"], """SELECT branch, shift, recommended_staff, mean_staff,
       min_staff, max_staff FROM shift_summary
 ORDER BY recommended_staff DESC, branch, shift LIMIT 4""")
oracle("worst_decline", ["st"], """SELECT arg_min(branch, growth_pct) AS worst_branch,
       min(growth_pct) AS worst_growth_pct, count(*) AS n_declining
  FROM st WHERE growth_pct < -5""")
oracle("expansion_recommendations", ["signals", "cand"], """,
  ranked AS (SELECT location, demand_base * (1 + g / 100) AS d, competition_risk AS r,
                    demand_base * (1 + g / 100) * growth_factor - competition_risk * 0.3 AS c
             FROM cand, (SELECT avg_monthly_growth_pct AS g FROM signals)
             ORDER BY c DESC, location LIMIT 2)
SELECT CAST(0 AS INTEGER) AS rank,
       CASE WHEN feasibility = 'RECOMMENDED'
            THEN format('Expansion is RECOMMENDED. Network shows {:.1f}% avg monthly growth '
                        || 'with {} total customers across {} branches.',
                        avg_monthly_growth_pct, total_customers, n_branches)
            ELSE format('Expansion is PREMATURE. Avg monthly growth is only {:.1f}%. '
                        || 'Focus on optimising existing branch performance first.',
                        avg_monthly_growth_pct) END AS recommendation
  FROM signals
UNION ALL
SELECT CAST(row_number() OVER (ORDER BY c DESC, location) AS INTEGER),
       format('Consider {} (demand score {}, competition risk {}, composite {}).', location,
              CAST(round_even(d, 1) AS VARCHAR), CAST(round_even(r, 1) AS VARCHAR),
              CAST(round_even(c, 1) AS VARCHAR))
  FROM ranked, signals WHERE feasibility = 'RECOMMENDED'""")


# --- report round trips ------------------------------------------------------------
def _money_text(x: str) -> str:
    return f"CAST(replace(format('{{:,.2f}}', {x}), ',', '') AS DOUBLE)"


def _fixed2(x: str) -> str:
    return f"CAST(format('{{:.2f}}', {x}) AS DOUBLE)"


oracle("report_monthly_sales", ["monthly_sales"], f"""SELECT branch,
       strftime(make_date(year, month_num, 1), '%B') AS month, year,
       {_money_text('total_sales')} AS total_sales, month_num FROM monthly_sales""")
oracle("report_branch_revenue", ["branch_revenue"], f"""SELECT branch,
       {_money_text('revenue')} AS revenue FROM branch_revenue""")
oracle("report_item_sales", ["item_sales"], f"""SELECT branch, division, grp AS "group", item,
       {_fixed2('sum(qty)')} AS qty,
       {_money_text('CAST(sum(CAST(total_amount AS DECIMAL(18,2))) AS DOUBLE)')} AS total_amount
  FROM item_sales GROUP BY branch, division, grp, item""")
oracle("report_delivery_lines", ["lp"], f"""SELECT branch,
       'Person_' || CAST(l_orderkey AS VARCHAR) AS customer, p_brand AS item,
       {_fixed2('l_quantity')} AS qty, {_money_text('l_extendedprice')} AS price FROM lp""")
oracle("report_customer_orders", [], f""", x AS (SELECT 1)
SELECT c_mktsegment AS branch, 'Person_' || CAST(c_custkey AS VARCHAR) AS customer,
       min(o_orderdate) AS first_order, max(o_orderdate) AS last_order,
       {_money_text('CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE)')} AS total,
       CAST(count(*) AS INTEGER) AS num_orders
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment, c_custkey""")
oracle("report_attendance", [], """, x AS (SELECT 1)
SELECT CAST(user_id AS INTEGER) AS employee_id,
       format('Person_{:04d}', user_id) AS employee_name,
       'Store ' || event_type AS branch, CAST(ts AS DATE) AS date,
       strftime(ts, '%H.%M.%S') AS punch_in,
       h + m / 60.0::DOUBLE + s / 3600.0::DOUBLE AS work_hours
  FROM (SELECT *, CAST(floor(value) AS BIGINT) AS h,
               CAST(floor(value * 60) AS BIGINT) % 60 AS m,
               CAST(floor(value * 3600) AS BIGINT) % 60 AS s FROM events)""")
oracle("report_menu_channels", ["menu_channels"], f"""SELECT branch, menu_channel,
       {_fixed2('num_customers')} AS num_customers, {_fixed2('sales')} AS sales,
       {_fixed2('sales / num_customers')} AS avg_per_customer FROM menu_channels""")
oracle("report_division_summary", ["lp"], """, d AS (
    SELECT branch, l_returnflag, l_extendedprice, p_type FROM lp)
SELECT branch, category,
       CAST(format('{:.2f}', delivery) AS DOUBLE) AS delivery,
       CAST(format('{:.2f}', dine_in) AS DOUBLE) AS "table",
       CAST(format('{:.2f}', takeaway) AS DOUBLE) AS takeaway,
       CAST(format('{:.2f}', total) AS DOUBLE) AS total
  FROM (SELECT branch,
               upper(p_type[1]) || lower(p_type[2:]) || ' Delivery' AS category,
               CAST(coalesce(sum(CAST(l_extendedprice AS DECIMAL(18,2)))
                             FILTER (WHERE l_returnflag = 'R'), 0) AS DOUBLE) AS delivery,
               CAST(coalesce(sum(CAST(l_extendedprice AS DECIMAL(18,2)))
                             FILTER (WHERE l_returnflag = 'A'), 0) AS DOUBLE) AS dine_in,
               CAST(coalesce(sum(CAST(l_extendedprice AS DECIMAL(18,2)))
                             FILTER (WHERE l_returnflag = 'N'), 0) AS DOUBLE) AS takeaway,
               CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total
        FROM d GROUP BY 1, 2)""")


# --- operators that compose, refine or bound their work --------------------------
ORACLE["top_item_pairs"] = ORACLE["item_pairs"]
_ROLLUP = """SELECT '{level}' AS level, {columns}, count(DISTINCT employee_id) AS distinct_staff
  FROM (SELECT *, strftime(date, '%Y-%m') AS month FROM att_s WHERE branch IS NOT NULL AND date IS NOT NULL) {group}"""
_ROLLUP_KEYS = {"branch": "VARCHAR", "shift": "VARCHAR", "date": "DATE", "day_of_week": "VARCHAR", "month": "VARCHAR"}
oracle("staff_rollup", ["att_s"], "\nUNION ALL\n".join(
    _ROLLUP.format(level=level, group=f"GROUP BY {', '.join(by)}" if by else "",
                   columns=", ".join(k if k in by else f"CAST(NULL AS {kind}) AS {k}" for k, kind in _ROLLUP_KEYS.items()))
    for level, by in {"day": ["branch", "shift", "date", "day_of_week", "month"], "weekday": ["branch", "day_of_week", "shift"],
                      "month": ["branch", "shift", "month"], "branch": ["branch"], "network": []}.items()))
oracle("hours_quantiles", ["attendance"], """SELECT branch, count(*) AS n, CAST(median(work_hours) AS DOUBLE) AS median,
       quantile_disc(work_hours, 0.1) AS q10, quantile_disc(work_hours, 0.25) AS q25, quantile_disc(work_hours, 0.5) AS q50,
       quantile_disc(work_hours, 0.75) AS q75, quantile_disc(work_hours, 0.9) AS q90
  FROM attendance WHERE work_hours > 0.5 AND branch IS NOT NULL GROUP BY 1""")
oracle("demand_fit", ["st"], """SELECT branch, n_months, historical_mean, growth_pct, slope, intercept, forecast,
       forecast * 0.9 AS lower, forecast * 1.1 AS upper
  FROM (SELECT *, (greatest(intercept + slope * (n_months + 1), 0.0) + greatest(intercept + slope * (n_months + 2), 0.0)
                   + greatest(intercept + slope * (n_months + 3), 0.0)) / 3 AS forecast FROM st)""")
ORACLE["demand_fit_appended"] = ORACLE["demand_fit"]

# --- bins, catalog, store, overview ------------------------------------------------
# columns of the driver's tables that are not nested, and their types
_COLUMNS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, "
        "o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice "
        "double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}
_NUMBERS = ("int", "bigint", "float", "double")
_PROFILE = """SELECT '{table}' AS dataset, '{column}' AS "column", '{kind}' AS type, count(*) AS n_rows, count(*) - count({column}) AS n_nulls,
       {least} AS least, {greatest} AS greatest FROM {table}"""
ORACLE["column_profile"] = "\nUNION ALL\n".join(
    _PROFILE.format(table=table, column=column, kind=kind, **{
        name: f"CAST({fn}({column}) AS DOUBLE)" if kind in _NUMBERS else "CAST(NULL AS DOUBLE)" for name, fn in (("least", "min"), ("greatest", "max"))})
    for table, columns in _COLUMNS.items() for column, kind in (c.rsplit(" ", 1) for c in columns.split(", ")))
ORACLE["itemsets_vertical"] = ORACLE["frequent_itemsets"]
ORACLE["topic_classify_one_pass"] = ORACLE["topic_classify"]
oracle("shift_bins", ["att_s"], """, span AS (SELECT min(date) AS a, max(date) AS b FROM att_s WHERE branch IS NOT NULL),
  own AS (SELECT DISTINCT branch, ascii(substring(branch, 1, 1)) % 20 AS h FROM att_s WHERE branch IS NOT NULL),
  bins AS (SELECT CAST(NULL AS VARCHAR) AS branch, a AS f, b AS u, x.* FROM span,
             (VALUES (6, 14, 'morning', 1), (14, 22, 'afternoon', 1), (22, 6, 'night', 1)) x(h0, h1, label, rank)
           UNION ALL SELECT branch, a + CAST((b - a) // 2 AS INTEGER), b, h, h + 3, 'rush', 2 FROM own, span
           UNION ALL SELECT branch, a, b, 12, 13, 'noon', 1 FROM own, span),
  r AS (SELECT row_number() OVER () AS id, * FROM att_s WHERE branch IS NOT NULL),
  hits AS (SELECT r.id, first(label ORDER BY (bins.branch IS NULL), rank, label) AS bin
           FROM r JOIN bins ON (bins.branch IS NULL OR bins.branch = r.branch) AND r.date BETWEEN f AND u
            AND CASE WHEN h0 < h1 THEN punch_hour >= h0 AND punch_hour < h1 ELSE punch_hour >= h0 OR punch_hour < h1 END
           GROUP BY r.id)
SELECT branch, coalesce(bin, 'Unknown') AS bin, strftime(date, '%Y-%m') AS month, count(*) AS n_records
  FROM r LEFT JOIN hits USING (id) GROUP BY 1, 2, 3""")
_CATALOG = {"monthly_sales": ("report_monthly_sales", 5), "branch_revenue": ("report_branch_revenue", 2),
            "sales_by_item": ("report_item_sales", 6), "delivery_items": ("report_delivery_lines", 5),
            "customer_orders": ("report_customer_orders", 6), "attendance": ("report_attendance", 7),
            "menu_avg_sales": ("report_menu_channels", 5), "division_summary": ("report_division_summary", 6)}
ORACLE["report_catalog"] = "\nUNION ALL\n".join(
    f"SELECT '{name}' AS dataset, count(*) AS n_rows, CAST({columns} AS INTEGER) AS n_columns FROM ({ORACLE[key]})"
    for name, (key, columns) in _CATALOG.items())
_PUBLISHED = {
    "shift_staffing": "branch, days_observed, max_staff, mean_staff, min_staff, recommended_staff, shift",
    "staffing_by_day": "branch, day_of_week, distinct_staff, shift",
    "staffing_alerts": "alert, branch, recommendation, shift",
    "demand_forecast": "branch, forecast, lower, month_num, period, step, upper, variance_pct, year",
    "demand_ranking": "avg_forecast, branch",
    "demand_trend": "branch, growth_pct, trend, trend_band",
    "branch_kpis": "avg_spend, branch, monthly_growth_pct, num_customers, pct_1_urgent, pct_2_high, pct_3_medium, pct_4_not_specified, "
                   "pct_5_low, revenue_share_pct, total_revenue",
    "expansion_signals": "avg_monthly_growth_pct, feasibility, growing_network, high_customer_density, max_share_pct, n_branches, "
                         "saturated_branch, saturated_branch_present, signal_score, total_customers, total_revenue",
    "score_candidates": "competition_risk, composite_score, demand_score, location",
    "segment_share": "branch, branch_total, segment, segment_revenue, share_pct",
    "segment_comparison": "branch, segment, total_qty, total_revenue",
    "segment_performance": "branch, segment, share_pct, status, threshold_pct",
    "growth_actions": "action, expected_impact, priority, rank, strategy, target",
    "combo_top": "antecedents, confidence, consequents, items, lift, priority, recommendation, strength, support",
}
ORACLE["published_reports"] = "\nUNION ALL\n".join(
    f"SELECT '{name}' AS report, count(*) AS n_rows, CAST({len(columns.split(','))} AS INTEGER) AS n_columns, '{columns}' AS columns FROM ({ORACLE[name]})"
    for name, columns in _PUBLISHED.items())
_OVERVIEW = {"demand_ranking": ("demand_ranking", "branch", "avg_forecast", "CAST(NULL AS VARCHAR)", "avg_forecast DESC, branch"),
             "locations": ("score_candidates", "location", "composite_score", "CAST(NULL AS VARCHAR)", "composite_score DESC, location"),
             "combos": ("combo_top", "items", "lift", "recommendation", "lift DESC, antecedents, consequents"),
             "staffing": ("staffing_alerts", "concat_ws(' – ', branch, shift)", "CAST(NULL AS DOUBLE)", "coalesce(alert, recommendation)", "branch, shift"),
             "growth_actions": ("growth_actions", "strategy", "CAST(rank AS DOUBLE)", "action", "rank")}
ORACLE["overview_sections"] = "\nUNION ALL\n".join(
    f"SELECT '{section}' AS section, CAST(row_number() OVER (ORDER BY {by}) AS INTEGER) AS position, {name} AS name, {value} AS value, {text} AS text "
    f"FROM ({ORACLE[key]})" for section, (key, name, value, text, by) in _OVERVIEW.items())
