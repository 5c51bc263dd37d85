"""DuckDB oracle SQL for every relational query key.

Each text runs on the driver's pre-registered views (``orders``, ``customer``,
``lineitem`` ...). Derived inputs (``credit_book``, ``scored`` ...) are inlined as
CTEs so the texts are self-contained. Rounding follows the shared rule:
``round_even(x * 1e4, 0) / 1e4`` here and ``rint(x * 1e4) / 1e4`` in Spark.
"""

from __future__ import annotations

# Derived inputs, in dependency order.
_CTES: dict[str, tuple[str, list[str]]] = {}


def _cte(name: str, deps: list[str], body: str) -> None:
    _CTES[name] = (body, deps)


_cte("credit_book", [], """
  with li as (
    select l_orderkey, count(*) as n_lines,
           cast(sum(cast(floor(l_discount * 100.0E0 + 0.5E0) as bigint)) as bigint) as disc_cents,
           max(case when l_tax >= 0.075E0 then 1 else 0 end) as top_tax
    from lineitem group by l_orderkey),
  b as (
    select o_orderkey as loan_id, o_custkey as customer_id,
      18 + c_custkey % 57 as person_age,
      cast(floor(least(500000.0E0, greatest(12000.0E0, 12000.0E0 + (c_acctbal + 1000.0E0) * 12.0E0))) as bigint) as person_income,
      case when o_orderkey % 37 = 0 then null else cast(o_orderkey % 13 as double) end as person_emp_length,
      case when o_orderkey % 41 = 0 then null else c_mktsegment end as loan_intent,
      case substr(o_orderpriority, 1, 1) when '1' then 'A' when '2' then 'B' when '3' then 'C'
           when '4' then 'D' else 'E' end as loan_grade,
      cast(floor(least(50000.0E0, greatest(500.0E0, o_totalprice / 10.0E0))) as bigint) as loan_amnt,
      5.0E0 + 2.0E0 * cast(disc_cents as double) / cast(n_lines as double) as loan_int_rate,
      case when top_tax = 1 then 'Y' else 'N' end as cb_person_default_on_file,
      1 + c_custkey % 45 as cb_person_cred_hist_length
    from orders join customer on c_custkey = o_custkey left join li on l_orderkey = o_orderkey),
  p as (select b.*, (round_even(cast(loan_amnt as double) / cast(person_income as double) * 10000.0E0, 0) / 10000.0E0 + 0.0E0)
               as loan_percent_income from b),
  s as (
    select p.*, -2.5E0
      + case when cb_person_default_on_file = 'Y' then 2.5E0 else 0.0E0 end
      + case when loan_percent_income > 0.40E0 then 2.0E0 else 0.0E0 end
      + 1.5E0 * (case loan_grade when 'A' then 0.0E0 when 'B' then 0.1E0 when 'C' then 0.2E0
                 when 'D' then 0.35E0 when 'E' then 0.5E0 when 'F' then 0.65E0 end)
      + case when loan_int_rate > 15.0E0 then 0.8E0 else 0.0E0 end
      + case when person_emp_length < 2.0E0 then 0.5E0 else 0.0E0 end
      - case when person_income > 100000 then 0.8E0 else 0.0E0 end as scorecard_logit
    from p)
  select s.*, case when scorecard_logit + (cast((loan_id * 7919) % 1000 as double) / 1000.0E0 - 0.5E0) * 2.77E0 > 0.0E0
                   then 1 else 0 end as loan_status
  from s""")

_cte("applicants", ["credit_book"], """
  select loan_id, person_age, person_income, person_emp_length, loan_intent, loan_grade, loan_amnt,
         loan_int_rate, loan_percent_income, cb_person_default_on_file, cb_person_cred_hist_length, loan_status
  from credit_book""")

_cte("scored", ["credit_book"], """
  select credit_book.*,
    round_even(1.0E0 / (1.0E0 + exp(-scorecard_logit)) * 10000.0E0, 0) / 10000.0E0 as default_prob,
    case when 1.0E0 / (1.0E0 + exp(-scorecard_logit)) < 0.3E0 then 'LOW'
         when 1.0E0 / (1.0E0 + exp(-scorecard_logit)) <= 0.6E0 then 'MEDIUM'
         when 1.0E0 / (1.0E0 + exp(-scorecard_logit)) > 0.6E0 then 'HIGH' end as risk_level,
    round_even(1.0E0 / (1.0E0 + exp(-scorecard_logit)) * 100.0E0 * 10.0E0, 0) / 10.0E0 as risk_score
  from credit_book""")

_cte("credit_wide", ["applicants"], """
  select applicants.*, case when loan_id % 10 < 7 then null else cast(loan_amnt as double) end as mostly_null
  from applicants""")

_cte("events_plain", [], "select ts, user_id, event_type, value, props from events")

_cte("lineitem_flags", [], "select l_returnflag, l_linestatus, l_quantity from lineitem")

_cte("lineitem_repeated", [], """
  select * replace (cast(l_shipdate as varchar) as l_shipdate) from lineitem union all
  select * replace (cast(l_shipdate as varchar) as l_shipdate) from lineitem where l_orderkey % 10 = 0""")

_cte("rule_clusters", ["applicants"], """
  select applicants.*, cast(ascii(loan_grade) - 65 as integer) as segment from applicants""")


def with_ctes(sql: str, *names: str) -> str:
    """Prefix ``sql`` with the CTEs it needs (and their dependencies), in order."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in _CTES[n][1]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    parts = [f"{n} as ({_CTES[n][0]})" for n in order]
    return "with " + ",\n".join(parts) + "\n" + sql


def r4(expr: str) -> str:
    return f"(round_even(({expr}) * 10000.0E0, 0) / 10000.0E0 + 0.0E0)"


def r2(expr: str) -> str:
    return f"(round_even(({expr}) * 100.0E0, 0) / 100.0E0 + 0.0E0)"


def r3(expr: str) -> str:
    return f"(round_even(({expr}) * 1000.0E0, 0) / 1000.0E0 + 0.0E0)"


SQL: dict[str, str] = {}


def register(key: str, sql: str, *ctes: str) -> None:
    SQL[key] = with_ctes(sql, *ctes) if ctes else sql
