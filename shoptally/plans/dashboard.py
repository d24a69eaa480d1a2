"""Dashboard: period slices, KPI cards, trends, store and staff metrics, tree, drill-through."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoptally.functions.calendar import VIEWS as UNITS
from shoptally.functions.calendar import axis_label, start_of
from shoptally.functions.columns import total
from shoptally.operators import drill, kpi, metrics, periods, pivot, tree
from shoptally.plans import views as V
from shoptally.plans.registry import query, register
from shoptally.sources.warehouse import sales

KPI_COLUMNS = ("date", "revenue", "qty", "invoice", "date_traffic", "lot_number")
TAIL = "(SELECT max(date) FROM sales)"


def daily_counts(df: DataFrame) -> DataFrame:
    """Fingerprint of a slice: lines, pieces and revenue per day."""
    return df.groupBy("date").agg(
        F.count("*").alias("n_lines"), F.sum("qty").alias("pieces"),
        F.sum("revenue").cast("double").alias("revenue"))


SLICE = "SELECT date, count(*) AS n_lines, CAST(sum(qty) AS BIGINT) AS pieces, " \
        "CAST(sum(revenue) AS DOUBLE) AS revenue FROM cur GROUP BY date"

# --- period filters ----------------------------------------------------------------
MONTH_SO_FAR = f"SELECT * FROM sales WHERE strftime(date, '%Y-%m') = strftime({TAIL}, '%Y-%m')"
PREV_MONTH_DAYS = f"CAST(day(last_day({TAIL} - INTERVAL 1 MONTH)) AS INTEGER)"
PERIODS = {
    "period_month_so_far": ("F1", {"mode": "month_so_far"}, MONTH_SO_FAR),
    "period_last_month_days": (
        "F2", {"mode": "last_month_days"},
        f"SELECT * FROM sales WHERE date > {TAIL} - {PREV_MONTH_DAYS}"),
    "period_last_months_head_tail": (
        "F3 X4", {"mode": "last_xy", "x": 3, "unit": "mo", "head": True, "tail": True},
        f"SELECT * FROM sales WHERE date >= date_trunc('month', {TAIL} - INTERVAL 3 MONTH) "
        f"AND date < date_trunc('month', {TAIL})"),
    "period_last_weeks_head": (
        "F3", {"mode": "last_xy", "x": 5, "unit": "w", "head": True},
        f"SELECT * FROM sales WHERE date >= date_trunc('week', {TAIL} - INTERVAL 35 DAY)"),
    "period_last_months": (
        "F3", {"mode": "last_xy", "x": 2, "unit": "mo"},
        f"SELECT * FROM sales WHERE date > {TAIL} - INTERVAL 2 MONTH"),
    "period_last_days": (
        "F3", {"mode": "last_xy", "x": 10, "unit": "d", "head": True, "tail": True},
        f"SELECT * FROM sales WHERE date > {TAIL} - 10"),
    "period_all_time": ("F4", {"mode": "all_time"}, "SELECT * FROM sales WHERE date IS NOT NULL"),
    "period_custom_last_week": (
        "F5", {"mode": "custom"}, f"SELECT * FROM sales WHERE date BETWEEN {TAIL} - 6 AND {TAIL}"),
}
for _name, (_ids, _args, _cur) in PERIODS.items():
    register(
        _name,
        lambda spark, d, a=_args: daily_counts(
            periods.current(sales(spark, d, "date", "qty", "revenue"), **a)),
        V.sql("sales", SLICE, cur=_cur), _ids)

PREV = ("SELECT * FROM sales WHERE date >= (SELECT CAST(min(date) AS DATE) - "
        "CAST(max(date) - min(date) + 1 AS INTEGER) FROM cur) AND date < (SELECT min(date) FROM cur)")


@query("F0 X5", V.sql("sales", f"""
SELECT strftime({TAIL}, '%B') AS this_month_name, strftime({TAIL}, '%Y-%m') AS this_month_year,
       {PREV_MONTH_DAYS} AS prev_month_count, min(date) AS min_date, max(date) AS max_date
FROM sales"""))
def period_anchor_row(spark, d):
    return periods.anchor_row(sales(spark, d, "date"))


@query("F6 F7", V.sql("sales", """
SELECT CAST(min(date) - CAST(max(date) - min(date) + 1 AS INTEGER) AS DATE) AS prev_start, min(date) AS split,
       max(date) AS current_end FROM cur""", cur=MONTH_SO_FAR))
def period_bounds(spark, d):
    return periods.bounds(periods.current(sales(spark, d, "date"), "month_so_far"))


@query("F6", V.sql("sales", SLICE.replace("FROM cur", "FROM prev"), cur=MONTH_SO_FAR, prev=PREV))
def period_previous(spark, d):
    facts = sales(spark, d, "date", "qty", "revenue")
    return daily_counts(periods.previous(facts, periods.current(facts, "month_so_far")))


@query("F8", V.sql("sales", SLICE,
                   cur="SELECT * FROM sales WHERE staff = 'Staff_3' AND cat = 'PROMO'"))
def filter_staff_and_category(spark, d):
    facts = sales(spark, d, "date", "qty", "revenue", "staff", "cat", "store_id")
    return daily_counts(periods.where_dims(
        facts, {"staff": "Staff_3", "cat": "PROMO", "store_id": "All Store_Id"}))


@query("F9", V.sql("sales", """
SELECT 'staff' AS dim, staff AS choice FROM cur WHERE staff IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'cat', cat FROM cur WHERE cat IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'sub_cat', sub_cat FROM cur WHERE sub_cat IS NOT NULL GROUP BY ALL""",
                      cur=MONTH_SO_FAR))
def filter_choices(spark, d):
    facts = sales(spark, d, "date", "staff", "cat", "sub_cat")
    return periods.choices(periods.current(facts, "month_so_far"), ["staff", "cat", "sub_cat"])


# --- KPI cards ---------------------------------------------------------------------------
def _cards_sql(source: str) -> str:
    return f"""
SELECT CAST(revenue AS DOUBLE) AS "Revenue", CAST(invoices AS DOUBLE) AS "Transaction",
       CAST(invoices AS DOUBLE) / nullif(CAST(traffic AS DOUBLE), 0) AS "Conversion",
       CAST(qty AS DOUBLE) / nullif(CAST(invoices AS DOUBLE), 0) AS "UPT",
       CAST(revenue AS DOUBLE) / nullif(CAST(invoices AS DOUBLE), 0) AS "ATV",
       CAST(traffic AS DOUBLE) AS "Traffic", CAST(qty AS DOUBLE) AS "Unit",
       CAST(lots AS DOUBLE) AS "Device"
FROM (SELECT coalesce(sum(revenue), 0) AS revenue, coalesce(sum(qty), 0) AS qty,
             coalesce(sum(invoices), 0) AS invoices, coalesce(sum(traffic), 0) AS traffic,
             coalesce(sum(lots), 0) AS lots
      FROM (SELECT date, sum(revenue) AS revenue, sum(qty) AS qty,
                   count(DISTINCT invoice) AS invoices, max(date_traffic) AS traffic,
                   count(DISTINCT lot_number) AS lots FROM {source} GROUP BY date))"""


def _unpivot(view: str, value: str) -> str:
    return f"SELECT * FROM {view} UNPIVOT ({value} FOR metric IN ({', '.join(kpi.CARDS)}))"


HUMAN = """CASE WHEN metric = 'Conversion' AND curr <= 1 THEN printf('%.1f%%', curr * 100.0E0)
 WHEN metric = 'Conversion' THEN printf('%.1f%%', curr)
 WHEN curr >= 1e9 THEN printf('%.2fB', curr / 1e9) WHEN curr >= 1e6 THEN printf('%.2fM', curr / 1e6)
 WHEN curr >= 1e3 THEN printf('%.1fk', curr / 1e3) WHEN curr >= 10 THEN printf('%.0f', curr)
 ELSE printf('%.2f', curr) END"""
KPI_SQL = V.sql("sales", f"""
SELECT metric, curr, prev,
       coalesce({V.round_even('(curr / nullif(prev, 0) - 1) * 100.0E0', 1)}, 0.0E0) AS delta_pct,
       {HUMAN} AS shown
FROM c JOIN p USING (metric)""", cur=MONTH_SO_FAR, prev=PREV, cc=_cards_sql("cur"),
                pp=_cards_sql("prev"), c=_unpivot("cc", "curr"), p=_unpivot("pp", "prev"))


@query("A4 M17 M18 F1 F6 X9", KPI_SQL)
def kpi_cards(spark, d):
    return kpi.period_cards(sales(spark, d, *KPI_COLUMNS), "month_so_far")


@query("A4", V.sql("sales", """
SELECT date, CAST(sum(revenue) AS DOUBLE) AS revenue, CAST(sum(qty) AS BIGINT) AS qty,
       count(DISTINCT invoice) AS invoices, CAST(max(date_traffic) AS BIGINT) AS traffic,
       count(DISTINCT lot_number) AS lots FROM sales GROUP BY date"""))
def kpi_daily(spark, d):
    daily = kpi.daily(sales(spark, d, *KPI_COLUMNS))
    return daily.withColumn("revenue", F.col("revenue").cast("double"))


@query("A19", V.sql("sales", "SELECT count(DISTINCT date) AS n_days, max(date) AS last_date FROM cur",
                    cur=MONTH_SO_FAR))
def kpi_slice_facts(spark, d):
    return kpi.slice_facts(periods.current(sales(spark, d, "date"), "month_so_far"))


# --- formula metrics ------------------------------------------------------------------------
AGG_SQL = {
    "sum": "sum({c})", "first": "max({c})", "mean": "avg({c})",
    "n_unique": "count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)",
}
NUM = "CAST({} AS DOUBLE)"


def _ratio_sql(a: str, b: str) -> str:
    return f"CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0)"


FORMULA_SQL = {
    "staff_performance": "CAST(revenue AS DOUBLE)",
    "staff_devices_sold": "CAST(lot_number AS DOUBLE)",
    "staff_transactions": "CAST(invoice AS DOUBLE)",
    "staff_attachment_rate": _ratio_sql("(qty - lot_number)", "lot_number"),
}


def metric_views(name: str, view: str) -> dict[str, str]:
    m = metrics.CATALOGUE[name]
    aggs = ", ".join(f"{AGG_SQL[how].format(c=c)} AS {c}" for c, how in m.daily.items())
    sums = ", ".join(f"sum({c}) AS {c}" for c in m.daily)
    formula = FORMULA_SQL.get(name) or _ratio_sql(*m.daily)
    return {
        "days": f"SELECT date, {m.group} AS grp, {aggs} FROM sales GROUP BY ALL",
        "periods": f"SELECT {V.trunc('date', view)} AS period, grp, {sums} FROM days GROUP BY ALL",
        "long": f"SELECT period, {V.axis_label('period', view)} AS label, grp, "
                f"coalesce({V.round_even(formula, m.digits)}, 0.0E0) AS value "
                "FROM periods WHERE grp IS NOT NULL",
    }


METRIC_IDS = dict(zip(metrics.CATALOGUE, (f"M{i}" for i in range(1, 15))))


def metric_long(spark, d, name: str, view: str) -> DataFrame:
    m = metrics.CATALOGUE[name]
    return metrics.by_group(sales(spark, d, "date", m.group, *m.daily), m, view)


for _name in metrics.CATALOGUE:
    _view = metrics.staff_view("1d") if _name in metrics.STAFF else "1mo"
    register(
        f"metric_{_name}", lambda spark, d, n=_name, v=_view: metric_long(spark, d, n, v),
        V.sql("sales", "SELECT * FROM long", **metric_views(_name, _view)),
        f"{METRIC_IDS[_name]} A1 A3")


@query("A3 X6", V.sql("sales", "SELECT * FROM long", **metric_views("conversion_rate", "1d")))
def metric_conversion_rate_daily(spark, d):
    return metric_long(spark, d, "conversion_rate", "1d")


STAFF_GROUPS = [f"Staff_{i}" for i in range(10)]
SPINE = {
    "1d": "SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date "
          "FROM sales",
}


@query("P1 J2 O3", V.sql(
    "sales",
    f"""SELECT s.period, {V.axis_label('s.period', '1w')} AS label, """
    + ", ".join(f"coalesce(max(CASE WHEN grp = '{g}' THEN value END), 0.0E0) AS {g}"
                for g in STAFF_GROUPS)
    + " FROM spine s LEFT JOIN long l ON s.period = l.period GROUP BY s.period",
    **metric_views("staff_attachment_rate", "1w"), daily_spine=SPINE["1d"],
    spine=f"SELECT DISTINCT {V.trunc('date', '1w')} AS period FROM daily_spine"))
def metric_wide_by_staff(spark, d):
    """Wide form for the groups of the staff table."""
    m = metrics.CATALOGUE["staff_attachment_rate"]
    facts = sales(spark, d, "date", m.group, *m.daily)
    return pivot.wide(metrics.by_group(facts, m, "1w"), facts, "1w", STAFF_GROUPS)


@query("O8", V.sql("sales", "SELECT grp, min(period) AS first_seen FROM long GROUP BY grp",
                   **metric_views("average_ticket_value", "1mo")))
def metric_groups_first_seen(spark, d):
    return metric_long(spark, d, "average_ticket_value", "1mo").groupBy("grp").agg(
        F.min("period").alias("first_seen")).orderBy("first_seen", "grp")


# --- trends -----------------------------------------------------------------------------------
def trend_views(daily: dict[str, str], view: str) -> dict[str, str]:
    aggs = ", ".join(f"{AGG_SQL[how].format(c=c)} AS {c}" for c, how in daily.items())
    sums = ", ".join(f"CAST(coalesce(sum({c}), 0) AS DOUBLE) AS {c}" for c in daily)
    return {
        "days": f"SELECT date, {aggs} FROM sales GROUP BY date",
        "spine": SPINE["1d"],
        "series": f"SELECT {V.trunc('s.date', view)} AS period, {sums} FROM spine s "
                  "LEFT JOIN days d ON s.date = d.date GROUP BY ALL",
    }


def _trend(name: str, daily: dict[str, str], view: str, ids: str) -> None:
    register(
        name, lambda spark, d: metrics.trend(sales(spark, d, "date", *daily), view, daily),
        V.sql("sales", f"SELECT *, {V.axis_label('period', view)} AS label FROM series",
              **trend_views(daily, view)), ids)


_trend("trend_revenue_traffic_weekly", metrics.REVENUE_TRAFFIC, "1w", "M15 A2 J1 A20")
_trend("trend_revenue_traffic_daily", metrics.REVENUE_TRAFFIC, "1d", "M15 J1 X6")
_trend("trend_promo_invoice_monthly", metrics.PROMO_INVOICE, "1mo", "M16 A2 A20 O3")


@query("A1", V.sql("sales", f"""
SELECT date, staff, CAST({AGG_SQL['sum'].format(c='revenue')} AS DOUBLE) AS revenue,
       CAST(sum(qty) AS DOUBLE) / count(qty) AS qty, CAST(max(date_traffic) AS BIGINT) AS date_traffic,
       {AGG_SQL['n_unique'].format(c='lot_number')} AS lot_number FROM sales GROUP BY date, staff"""))
def daily_aggregate_registry(spark, d):
    how = {"revenue": "sum", "qty": "mean", "date_traffic": "first", "lot_number": "n_unique"}
    out = metrics.by_day(sales(spark, d, "date", "staff", *how), ["date", "staff"], how)
    return out.withColumn("revenue", F.col("revenue").cast("double"))


@query("A20 J2", V.sql("sales", f"SELECT DISTINCT {V.trunc('date', '1mo')} AS date, "
                       f"{V.axis_label(V.trunc('date', '1mo'), '1mo')} AS label FROM spine",
                       spine=SPINE["1d"]))
def spine_months(spark, d):
    months = periods.period_spine(sales(spark, d, "date"), "1mo")
    return months.select("date", axis_label(F.col("date"), "1mo").alias("label"))


@query("A2", V.sql("sales", f"SELECT {V.trunc('date', '1w')} AS period, "
                   "CAST(sum(n) AS BIGINT) AS invoices FROM days GROUP BY ALL",
                   days="SELECT date, count(DISTINCT invoice) AS n FROM sales GROUP BY date"))
def weekly_sum_of_daily_uniques(spark, d):
    days = metrics.by_day(sales(spark, d, "date", "invoice"), ["date"], {"invoice": "n_unique"})
    return days.groupBy(start_of(F.col("date"), UNITS["1w"]).alias("period")).agg(
        total("invoice").alias("invoices"))


# --- tree ---------------------------------------------------------------------------------------
def tree_sql(layers: list[str], values: list[str], sqrt: bool) -> str:
    main = values[0]
    named = ", ".join(f"coalesce({c}, 'undefined') AS {c}" for c in layers)
    share = V.round_even(
        f"100.0E0 * CAST({main} AS DOUBLE) / nullif((SELECT CAST(sum({main}) AS DOUBLE) FROM sales), 0)",
        1)
    branches = []
    for n in range(len(layers) + 1):
        on = layers[:n]
        path = " || ' / ' || ".join(on) if on else "''"
        shown = on[-1] if on else "'Total'"
        shows = [f"CAST({v} AS DOUBLE) AS {v}" for v in values]
        if sqrt:
            shows[0] = f"sqrt(CAST({main} AS DOUBLE)) AS {main}, CAST({main} AS DOUBLE) AS raw_value"
        sums = ", ".join(f"sum({v}) AS {v}" for v in values)
        group = f"GROUP BY {', '.join(on)}" if on else ""
        keys = "".join(f"{c}, " for c in on)
        branches.append(
            f"SELECT {n} AS level, {path} AS path, {shown} AS name, {', '.join(shows)}, "
            f"coalesce({share}, 0.0E0) AS share_pct "
            f"FROM (SELECT {keys}{sums} FROM named {group})")
    return V.sql("sales", " UNION ALL ".join(branches),
                 named=f"SELECT {named}, {', '.join(values)} FROM sales")


TREE = ["cat", "sub_cat", "product_name", "sku"]


@query("A17 M19", tree_sql(TREE, ["revenue", "qty"], False))
def tree_revenue(spark, d):
    return tree.rollup(sales(spark, d, *TREE, "revenue", "qty"), TREE, ["revenue", "qty"])


@query("A17 M19 X8", tree_sql(["staff", *TREE[:3]], ["qty", "revenue"], True))
def tree_quantity_by_staff(spark, d):
    layers = ["staff", *TREE[:3]]
    return tree.rollup(sales(spark, d, *layers, "qty", "revenue"), layers, ["qty", "revenue"], True)


@query("O7 A17", tree_sql(["cat", "sub_cat"], ["revenue"], False))
def tree_by_value(spark, d):
    nodes = tree.rollup(sales(spark, d, "cat", "sub_cat", "revenue"), ["cat", "sub_cat"],
                        ["revenue"])
    return nodes.orderBy("level", F.col("revenue").desc(), "path")


# --- drill-through ---------------------------------------------------------------------------------
BUCKET = ("SELECT * FROM sales WHERE date >= (SELECT CAST(date_trunc('month', min(date)) AS DATE) "
          "+ INTERVAL 7 MONTH FROM sales) AND date < (SELECT CAST(date_trunc('month', min(date)) "
          "AS DATE) + INTERVAL 8 MONTH FROM sales)")
DRILL_COLUMNS = ("date", "invoice", "staff", "cat", "sku", "qty", "revenue", "date_traffic")


def _bucket(spark, d, *columns: str) -> DataFrame:
    facts = sales(spark, d, *(columns or DRILL_COLUMNS))
    return periods.bucket(facts, facts, "1mo", 7)


@query("F10 C13", V.sql("sales", "SELECT date, CAST(invoice AS VARCHAR) AS invoice, staff, cat, sku, qty, "
                        "CAST(revenue AS DOUBLE) AS revenue FROM cur", cur=BUCKET))
def drill_bucket_rows(spark, d):
    return _bucket(spark, d).select(
        "date", F.col("invoice").cast("string").alias("invoice"), "staff", "cat", "sku", "qty",
        F.col("revenue").cast("double").alias("revenue"))


def _regroup_sql(keys: list[str]) -> str:
    figures = {
        "invoice": AGG_SQL["n_unique"].format(c="invoice"), "qty": "CAST(sum(qty) AS BIGINT)",
        "revenue": "CAST(sum(revenue) AS DOUBLE)",
        "date_traffic": "CAST(max(date_traffic) AS BIGINT)",
    }
    shown = ", ".join(f"{v} AS {k}" for k, v in figures.items() if k not in keys)
    return f"SELECT {', '.join(keys)}, {shown} FROM cur GROUP BY {', '.join(keys)}"


def _as_double(df: DataFrame) -> DataFrame:
    return df.withColumn("revenue", F.col("revenue").cast("double"))


@query("A5", V.sql("sales", _regroup_sql(["staff", "cat"]), cur=BUCKET))
def drill_by_staff_and_category(spark, d):
    return _as_double(drill.regroup(_bucket(spark, d), ["staff", "cat"]))


@query("A5", V.sql("sales", _regroup_sql(["date", "invoice"]), cur="SELECT * FROM sales"))
def drill_by_date_and_invoice(spark, d):
    facts = sales(spark, d, "date", "invoice", "qty", "revenue", "date_traffic")
    return _as_double(drill.regroup(facts, ["date", "invoice"]))


@query("F11", V.sql("sales", f"SELECT * FROM ({_regroup_sql(['date', 'staff'])}) WHERE staff = 'Staff_7'",
                    cur=BUCKET))
def drill_only_one_staff(spark, d):
    grouped = drill.regroup(_bucket(spark, d), ["date", "staff"])
    return _as_double(drill.only(grouped, "staff", "Staff_7"))


@query("A6", V.sql("sales", "SELECT CAST(sum(qty) AS BIGINT) AS total_qty, "
                   "CAST(sum(revenue) AS DOUBLE) AS total_revenue FROM cur", cur=BUCKET))
def drill_totals(spark, d):
    sums = drill.grand_totals(_bucket(spark, d, "date", "qty", "revenue"))
    return sums.withColumn("total_revenue", F.col("total_revenue").cast("double"))
