"""Filters that a report's or a user's context builds: journal items, and the branches that a user may see."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewarden.plans.secure import domain
from lakewarden.registry import query
from lakewarden.sources.tables import SQL, accounts, customers, transactions

#: Context keys of lists, and the journal item's field that must be in each.
LISTS = {"journal_ids": "journal_id", "account_tag_ids": "account_tag_id", "account_ids": "account_id", "analytic_account_ids": "analytic_account_id", "partner_ids": "partner_id", "partner_categories": "partner_category_id"}


def journal_domain(context: dict, companies: Sequence[int]) -> list:
    """The domain of the journal items that a report's context asks for.

    Dates judge the date, or the due date of an aged balance. Without strict_range, items before date_from stay if their account carries its balance over; with it, initial_bal asks for what was before.
    A reconcile_date keeps what was unreconciled on it. Cancelled items, and lines that are sections or notes, never count.
    """
    day = "date_maturity" if context.get("aged_balance") else "date"
    terms: list = [(day, "<=", context["date_to"])] if context.get("date_to") else []
    if start := context.get("date_from"):
        if not context.get("strict_range"):
            terms += ["|", (day, ">=", start), ("include_initial_balance", "=", True)]
        else:
            terms.append((day, "<" if context.get("initial_bal") else ">=", start))
    if (state := context.get("state")) and state.lower() != "all":
        terms.append(("parent_state", "=", state))
    if on := context.get("reconcile_date"):
        terms += ["|", "!", ("reconciled", "=", True), "|", ("max_debit_date", ">", on), ("max_credit_date", ">", on)]
    terms += [(field, "in", list(context[key])) for key, field in LISTS.items() if context.get(key)]
    return [*terms, ("company_id", "in", list(companies)), ("display_type", "not in", ["line_section", "line_note"]), ("parent_state", "!=", "cancel")]


_ITEMS = SQL + """, i AS (SELECT account_id, amount, date_created AS date, date_created + (quantity::INT) AS date_maturity, channel_id % 5 = 0 AS include_initial_balance, channel_id % 4 AS journal_id, CASE WHEN flag = 'R' THEN 'posted' WHEN flag = 'A' THEN 'cancel' WHEN line < 6 THEN 'draft' END AS parent_state,
state = 'F' AS reconciled, CASE WHEN line = 2 THEN date_created + 100 END AS max_debit_date, part_id % 3 AS company_id, CASE WHEN line = 3 THEN 'line_note' WHEN line = 4 THEN 'product' END AS display_type FROM txn)"""
_BASE = "company_id IN (1, 2) AND (display_type NOT IN ('line_section', 'line_note') OR display_type IS NULL) AND (parent_state <> 'cancel' OR parent_state IS NULL)"
_CONTEXTS = {
    "plain": ({"date_from": "1995-01-01", "date_to": "1996-06-30"}, "date <= '1996-06-30' AND (date >= '1995-01-01' OR include_initial_balance)"),
    "strict": ({"date_from": "1995-01-01", "strict_range": True, "journal_ids": [0, 2], "state": "posted"}, "date >= '1995-01-01' AND journal_id IN (0, 2) AND parent_state = 'posted'"),
    "opening": ({"date_from": "1995-01-01", "strict_range": True, "initial_bal": True, "state": "All"}, "date < '1995-01-01'"),
    "aged": ({"date_to": "1996-01-31", "aged_balance": True, "reconcile_date": "1996-01-31"}, "date_maturity <= '1996-01-31' AND (NOT reconciled OR max_debit_date > '1996-01-31')"),
    "all": ({}, "true"),
}


@query(_ITEMS + " UNION ALL ".join(f" SELECT '{name}' AS context, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS amount FROM i WHERE {_BASE} AND ({where})" for name, (_, where) in _CONTEXTS.items()))
def journal_contexts(spark: SparkSession, d: str) -> DataFrame:
    """Journal items by five reports' contexts, in one pass."""
    n, line = F.col("channel_id"), F.col("line")
    state = F.when(F.col("flag") == "R", "posted").when(F.col("flag") == "A", "cancel").when(line < 6, "draft")
    items = transactions(spark, d).select(
        "amount", F.col("date_created").alias("date"), F.date_add("date_created", F.col("quantity").cast("int")).alias("date_maturity"), (n % 5 == 0).alias("include_initial_balance"), (n % 4).alias("journal_id"), state.alias("parent_state"), (F.col("state") == "F").alias("reconciled"),
        F.when(line == 2, F.date_add("date_created", 100)).alias("max_debit_date"), F.lit(None).cast("date").alias("max_credit_date"), (F.col("part_id") % 3).alias("company_id"), F.when(line == 3, "line_note").when(line == 4, "product").alias("display_type"),
    )
    sums = []
    for name, (context, _) in _CONTEXTS.items():
        on = domain(journal_domain(context, [1, 2]))
        sums.append(F.struct(F.lit(name).alias("context"), F.count_if(on).alias("n"), F.sum(F.when(on, F.col("amount"))).cast("double").alias("amount")))
    return items.agg(F.array(*sums).alias("s")).select(F.inline("s"))


def effective_branches(users: DataFrame, listed: DataFrame, granted: DataFrame) -> DataFrame:
    """user_id, unrestricted, branch_id: a row for each branch that a user may see, of users(user_id, branch_id, admin), listed and granted(user_id, branch_id); an administrator has one row, unrestricted,
    and a user without any branch one with none, who sees nothing."""
    pairs = reduce(DataFrame.unionByName, (df.select("user_id", "branch_id") for df in (users, listed, granted))).filter("branch_id is not null").distinct()
    plain = users.filter(~F.coalesce("admin", F.lit(False))).select("user_id").distinct()
    own = plain.join(pairs, "user_id", "left").select("user_id", F.lit(False).alias("unrestricted"), "branch_id")
    return own.unionByName(users.filter("admin").select("user_id", F.lit(True).alias("unrestricted"), F.lit(None).cast(users.schema["branch_id"].dataType).alias("branch_id")).distinct())


@query(SQL + """, u AS (SELECT customer_id AS user_id, CASE WHEN customer_id % 4 > 0 THEN branch_id END AS branch_id, score > 9500 AS admin FROM cust), p AS (SELECT user_id, branch_id FROM u UNION SELECT customer_id, account_id % 25 FROM acct WHERE state = 'P' UNION SELECT customer_id, CAST(floor(balance) AS BIGINT) % 25 FROM acct WHERE product = '1-URGENT' AND state = 'O')
SELECT u.user_id, false AS unrestricted, p.branch_id FROM u LEFT JOIN (SELECT * FROM p WHERE branch_id IS NOT NULL) p USING (user_id) WHERE NOT admin UNION ALL SELECT user_id, true, NULL FROM u WHERE admin""")
def user_branches(spark: SparkSession, d: str) -> DataFrame:
    """Customers as users: their own branch, those of their partial accounts as a list, those of urgent ones as grants."""
    a = accounts(spark, d)
    users = customers(spark, d).select(F.col("customer_id").alias("user_id"), F.when(F.col("customer_id") % 4 > 0, F.col("branch_id")).cast("long").alias("branch_id"), (F.col("score") > 9500).alias("admin"))
    listed = a.filter("state = 'P'").select(F.col("customer_id").alias("user_id"), (F.col("account_id") % 25).alias("branch_id"))
    granted = a.filter("product = '1-URGENT' and state = 'O'").select(F.col("customer_id").alias("user_id"), (F.floor("balance") % 25).cast("long").alias("branch_id"))
    return effective_branches(users, listed, granted)
