"""Absence in work days by month and department: a calendar's week is summed once, so an interval is the difference of two running counts, and no day is a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewarden.registry import query
from lakewarden.sources.tables import SQL, accounts, transactions

ROUNDING = 16  #: parts of a day that a partly worked day is rounded to


def weeks(calendars: DataFrame) -> DataFrame:
    """calendars(calendar_id, weekday (0 is Monday), hour_from, hour_to) -> calendar_id, shifts, hours of each weekday, and days, the number of work days before each weekday and in all."""
    shifts = calendars.groupBy("calendar_id").agg(F.collect_list(F.struct("weekday", "hour_from", "hour_to")).alias("shifts"))  # a week has few
    hours = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda w: F.aggregate(F.filter("shifts", lambda s: s["weekday"] == w), F.lit(0.0), lambda a, s: a + s["hour_to"] - s["hour_from"]))
    made = shifts.withColumn("hours", hours)
    days = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda w: F.size(F.filter(F.slice("hours", 1, w), lambda h: h > 0)))
    return made.withColumn("days", days)


def _weekday(day: Column) -> Column:
    return F.pmod(F.unix_date(day) + 3, F.lit(7))  # day 0 was a Thursday


def _before(day: Column) -> Column:
    """Work days of the calendar from a fixed Monday up to a day, not included."""
    return F.expr("days[7]") * F.floor((F.unix_date(day) + 3) / 7) + F.element_at("days", (_weekday(day) + 1).cast("int"))


def _share(day: Column, start: Column, end: Column) -> Column:
    """The rounded share of a day's working hours between two hours."""
    within = F.aggregate(F.filter("shifts", lambda s: s["weekday"] == _weekday(day)), F.lit(0.0), lambda a, s: a + F.greatest(F.least(end, s["hour_to"]) - F.greatest(start, s["hour_from"]), F.lit(0.0)))
    hours = F.element_at("hours", (_weekday(day) + 1).cast("int"))
    return F.when(hours > 0, F.round(ROUNDING * within / hours) / ROUNDING).otherwise(0.0)


def work_days(start: Column, end: Column) -> Column:
    """Work days between two times, of the calendar whose columns weeks() made: the first and the last day by their hours, those between as they are."""
    first, last = F.to_date(start), F.to_date(end)
    hour = lambda c: (F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)) / 3600.0
    several = _share(first, hour(start), F.lit(24.0)) + (_before(last) - _before(F.date_add(first, 1))) + _share(last, F.lit(0.0), hour(end))
    return F.when(end <= start, 0.0).when(first == last, _share(first, hour(start), hour(end))).otherwise(several)


def absence(leaves: DataFrame, calendars: DataFrame, first_month: Column, last_month: Column) -> DataFrame:
    """leaves(department, calendar_id, date_from, date_to) -> month, department, days, in the months from first to last. A leave without department, calendar or ends does not count."""
    inside = leaves.filter("department is not null and date_from <= date_to").join(weeks(calendars), "calendar_id")
    from_, to = F.greatest(F.trunc("date_from", "month"), first_month), F.least(F.trunc("date_to", "month"), last_month)
    months = F.when(from_ <= to, F.sequence(from_, to, F.expr("interval 1 month")))
    each = inside.withColumn("month", F.explode(months))
    start = F.greatest(F.col("month").cast("timestamp_ntz"), F.col("date_from").cast("timestamp_ntz"))
    end = F.least(F.add_months("month", 1).cast("timestamp_ntz"), F.col("date_to").cast("timestamp_ntz"))
    return each.groupBy("month", "department").agg(F.sum(work_days(start, end)).alias("days"))


#: Three calendars of different weeks: two shifts on five days, one on six, and evenings on three.
CALENDARS = [(0, w, *s) for w in range(5) for s in ((8.0, 12.0), (13.0, 17.0))] + [(1, w, 9.0, 15.0) for w in range(6)] + [(2, w, 18.5, 24.0) for w in (1, 2, 3)]


@query(SQL + f""", cal(calendar_id, weekday, f, t) AS (VALUES {', '.join(map(str, CALENDARS))}), tot AS (SELECT calendar_id, weekday, sum(t - f) AS h FROM cal GROUP BY ALL),
d AS (SELECT account_id, product, min(date_created)::TIMESTAMP AS a, max(date_created)::TIMESTAMP AS b FROM txn JOIN acct USING (account_id) GROUP BY ALL),
s AS (SELECT account_id, product AS department, account_id % 3 AS calendar_id, a + INTERVAL 1 HOUR * (account_id % 23)::INT AS a, b + INTERVAL 1 MINUTE * (account_id % 1439)::INT AS b FROM d),
m AS (SELECT *, unnest(generate_series(date_trunc('month', a)::TIMESTAMP, date_trunc('month', b)::TIMESTAMP, INTERVAL 1 MONTH)) AS month FROM s WHERE a <= b),
w AS (SELECT account_id, department, calendar_id, month, greatest(a, month) AS lo, least(b, month + INTERVAL 1 MONTH) AS hi FROM m WHERE month BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-06-01'),
e AS (SELECT *, unnest(generate_series(date_trunc('day', lo)::TIMESTAMP, hi, INTERVAL 1 DAY)) AS day FROM w),
g AS (SELECT e.account_id, e.department, e.month, e.day, tot.h, sum(greatest(least(epoch(hi - day) / 3600, t) - greatest(epoch(lo - day) / 3600, f), 0)) AS x FROM e JOIN cal ON cal.calendar_id = e.calendar_id AND cal.weekday = isodow(day) - 1 JOIN tot ON tot.calendar_id = e.calendar_id AND tot.weekday = cal.weekday GROUP BY ALL)
SELECT CAST(w.month AS DATE) AS month, w.department, coalesce(sum(d), 0.0)::DOUBLE AS days FROM (SELECT DISTINCT month, department FROM w) w LEFT JOIN (SELECT month, department, round(16 * x / h) / 16 AS d FROM g) q ON q.month = w.month AND q.department = w.department GROUP BY 1, 2""")
def leave_days_department(spark: SparkSession, d: str) -> DataFrame:
    """Work days between the first and the last line of each account, as leaves by three calendars, by month and product over half a year."""
    n = F.col("account_id")
    spans = transactions(spark, d).groupBy("account_id").agg(F.min("date_created").alias("a"), F.max("date_created").alias("b"))
    at = lambda day, minutes: F.col(day).cast("timestamp_ntz") + F.make_dt_interval(mins=minutes.cast("int"))
    leaves = spans.join(accounts(spark, d).select("account_id", "product"), "account_id").select(F.col("product").alias("department"), (n % 3).cast("int").alias("calendar_id"), at("a", n % 23 * 60).alias("date_from"), at("b", n % 1439).alias("date_to"))
    calendars = spark.createDataFrame(CALENDARS, "calendar_id int, weekday int, hour_from double, hour_to double")
    month = lambda text: F.lit(text).cast("date")
    return absence(leaves, calendars, month("1996-01-01"), month("1996-06-01"))
