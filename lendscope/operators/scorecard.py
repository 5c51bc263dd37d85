"""Scorecard operators (E1-E4): the applicant label rule as column projections.

All are narrow projections: no shuffle, whole-stage codegen end to end.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendscope import settings as S
from lendscope.functions.columns import col_, r4, sigmoid


def _literal_map(mapping: dict) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in mapping.items()))


def grade_risk(grade: str | Column = "loan_grade") -> Column:
    return _literal_map(S.GRADE_RISK)[col_(grade)]


def scorecard_logit(
    prior_default: str | Column = "cb_person_default_on_file",
    lti: str | Column = "loan_percent_income",
    grade: str | Column = "loan_grade",
    rate: str | Column = "loan_int_rate",
    emp_length: str | Column = "person_emp_length",
    income: str | Column = "person_income",
) -> Column:
    """Logit of the scorecard; a NULL inside a comparison contributes 0 (NaN > x is False)."""
    def flag(cond: Column, weight: float) -> Column:
        return F.when(cond, F.lit(weight)).otherwise(F.lit(0.0))

    return (
        F.lit(S.SCORECARD_INTERCEPT)
        + flag(col_(prior_default) == F.lit("Y"), S.SCORECARD_PRIOR_DEFAULT)
        + flag(col_(lti) > F.lit(S.SCORECARD_LTI_CUT), S.SCORECARD_HIGH_LTI)
        + F.lit(S.SCORECARD_GRADE) * grade_risk(grade)
        + flag(col_(rate) > F.lit(S.SCORECARD_RATE_CUT), S.SCORECARD_HIGH_RATE)
        + flag(col_(emp_length) < F.lit(S.SCORECARD_TENURE_CUT), S.SCORECARD_SHORT_TENURE)
        - flag(col_(income) > F.lit(S.SCORECARD_INCOME_CUT), S.SCORECARD_HIGH_INCOME)
    )


def loan_to_income(df: DataFrame, loan: str = "loan_amnt", income: str = "person_income",
                   out: str = "loan_to_income") -> DataFrame:
    """Loan / income rounded to 4 dp (NULL when income is 0 or NULL)."""
    ratio = F.try_divide(F.col(loan).cast("double"), F.col(income).cast("double"))
    return df.withColumn(out, r4(ratio))


def clip_bounds(df: DataFrame) -> DataFrame:
    """Clip income, tenure, amount and credit history into the generator's bounds."""
    bounds = {
        "person_income": S.INCOME_BOUNDS,
        "person_emp_length": S.EMP_LENGTH_BOUNDS,
        "loan_amnt": S.LOAN_AMOUNT_BOUNDS,
        "cb_person_cred_hist_length": S.CRED_HIST_BOUNDS,
    }
    return df.withColumns({
        c: F.when(F.col(c).isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), F.col(c))))  # missing stays missing
        for c, (lo, hi) in bounds.items() if c in df.columns
    })


def grade_lookup(df: DataFrame, grade: str = "loan_grade") -> DataFrame:
    """Grade risk and the interest-rate band of the grade (literal map, no join)."""
    lows = {g: lo for g, (lo, _) in S.GRADE_RATE_BAND.items()}
    highs = {g: hi for g, (_, hi) in S.GRADE_RATE_BAND.items()}
    return df.withColumns({
        "grade_risk": grade_risk(grade),
        "rate_band_low": _literal_map(lows)[F.col(grade)],
        "rate_band_high": _literal_map(highs)[F.col(grade)],
    })


def scorecard(df: DataFrame) -> DataFrame:
    """Logit, probability (4 dp) and label ``p > 0.5`` (taken as ``z > 0``)."""
    z = scorecard_logit()
    return df.withColumns({
        "scorecard_logit": z,
    }).withColumns({
        "scorecard_prob": r4(sigmoid("scorecard_logit")),
        "scorecard_label": F.when(F.col("scorecard_logit") > F.lit(0.0), F.lit(1)).otherwise(F.lit(0)),
    })
