"""Fixed values and tunables in one place.

Everything under "Fixed values" must equal the behaviour being reproduced
(thresholds, name lists, product catalogue, scorecard weights); change them
and results change. Tunables below them are execution knobs only.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# Fixed values
# ---------------------------------------------------------------------------

RANDOM_STATE = 42
TEST_SIZE = 0.20

# Risk bands on the default probability: p < LOW -> LOW, p <= HIGH -> MEDIUM, else HIGH.
LOW_THRESHOLD = 0.30
HIGH_THRESHOLD = 0.60
RISK_LEVELS = ["LOW", "MEDIUM", "HIGH"]

# Target-name candidates, searched in this order, case-insensitively.
TARGET_COLUMN_CANDIDATES = [
    "loan_status", "default", "default_on_payment",
    "credit_default", "target", "label", "y",
    "defaulted", "loan_default", "bad_flag",
]
# Binary target heuristic: share of ones strictly inside these bounds.
TARGET_RATE_BOUNDS = (0.01, 0.90)

# A column whose lower-cased name contains any of these is an identifier.
ID_COLUMN_PATTERNS = [
    "id", "_id", "customer_id", "loan_id", "applicant_id",
    "account_id", "uuid", "index",
]

# Columns with a missing share above this are dropped during cleaning.
MAX_MISSING_RATIO = 0.60
MISSING_CATEGORY = "missing"
CLASS_IMBALANCE_SHARE = 0.15

# Model choice: weighted score of test metrics; the first model wins ties.
SELECTION_WEIGHTS = {"roc_auc": 0.50, "recall": 0.30, "f1": 0.20}

# Segmentation.
N_CLUSTERS_RANGE = (2, 8)
SEGMENT_MAX_FEATURES = 8
SEGMENT_SWEEP_STARTS = 10
SEGMENT_FINAL_STARTS = 20
PREFERRED_SEG_FEATURES = [
    "person_income", "loan_amnt", "loan_int_rate", "loan_percent_income",
    "person_age", "person_emp_length", "cb_person_cred_hist_length",
    "annual_inc", "annual_income", "income", "loan_amount",
    "credit_history_length", "age",
]
SEGMENT_LABELS = {
    "high_risk": "High-Risk Customer",
    "premium": "Premium Customer",
    "emerging": "Emerging Customer",
    "stable": "Stable Customer",
}
UNKNOWN_SEGMENT = "Unknown"

# Column aliases used by the dashboard and the assessment flow (first match wins).
INCOME_ALIASES = ["person_income", "income", "annual_inc"]
LOAN_ALIASES = ["loan_amnt", "loan_amount"]
LTI_ALIASES = ["loan_percent_income"]

# Income tiers for recommendations: > HIGH -> high, > MEDIUM -> medium, else low.
INCOME_TIER_HIGH = 120_000
INCOME_TIER_MEDIUM = 50_000

# Product catalogue, in presentation order:
# (product, allowed risk levels, description, base score)
PRODUCT_CATALOGUE = [
    ("Savings Account", ["LOW", "MEDIUM", "HIGH"],
     "A liquid, interest-bearing savings account.", 70),
    ("Credit Card", ["LOW", "MEDIUM"],
     "Revolving credit facility with rewards programme.", 75),
    ("Personal Loan", ["LOW", "MEDIUM"],
     "Unsecured personal loan with flexible tenure.", 65),
    ("Home Loan", ["LOW"],
     "Mortgage loan for property purchase or construction.", 80),
    ("Auto Loan", ["LOW", "MEDIUM"],
     "Vehicle financing up to 90% of on-road price.", 72),
    ("Fixed Deposit", ["LOW", "MEDIUM", "HIGH"],
     "Guaranteed returns with capital protection.", 68),
    ("Investment Account", ["LOW", "MEDIUM"],
     "Market-linked investment with growth potential.", 73),
    ("Insurance", ["LOW", "MEDIUM", "HIGH"],
     "Life and health protection coverage.", 74),
    ("Premium Banking Account", ["LOW"],
     "Exclusive banking with priority service and higher limits.", 85),
]

# Recommendation rule texts.
REASON_NOT_ALLOWED = "Not recommended for current risk profile."
REASON_LOW = "Low default risk ({pct}%) makes this a strong fit."
REASON_MEDIUM = "Moderate risk ({pct}%). Standard eligibility criteria apply."
REASON_HIGH_INCOME = " High income supports eligibility."
REASON_LOW_INCOME = " Lower income may limit access to premium products."
REASON_HIGH_LTI = " High existing loan-to-income ratio is a concern."
REASON_LOW_LTI = " Low existing debt burden supports additional credit."
REASON_SAFETY = " Financial safety products are recommended for risk-conscious customers."
NOTE_STRONG = "[OK] Strong match."
NOTE_GOOD = "[OK] Good match."
NOTE_CONDITIONAL = "ℹ️ Conditional match -- review eligibility."
DEFAULT_TOP_N = 5

# Scorecard (label rule of the applicant generator): bounds, grade lookups, logit terms.
INCOME_BOUNDS = (12_000, 500_000)
EMP_LENGTH_BOUNDS = (0, 40)
LOAN_AMOUNT_BOUNDS = (500, 50_000)
CRED_HIST_BOUNDS = (1, 45)
GRADE_RISK = {"A": 0.0, "B": 0.1, "C": 0.2, "D": 0.35, "E": 0.5, "F": 0.65}
GRADE_RATE_BAND = {
    "A": (5.0, 8.5), "B": (8.5, 11.5), "C": (11.5, 14.5),
    "D": (14.5, 17.5), "E": (17.5, 21.0), "F": (21.0, 25.0),
}
SCORECARD_INTERCEPT = -2.5
SCORECARD_PRIOR_DEFAULT = 2.5      # cb_person_default_on_file == 'Y'
SCORECARD_HIGH_LTI = 2.0           # loan_percent_income > 0.40
SCORECARD_LTI_CUT = 0.40
SCORECARD_GRADE = 1.5              # times grade risk
SCORECARD_HIGH_RATE = 0.8          # loan_int_rate > 15
SCORECARD_RATE_CUT = 15.0
SCORECARD_SHORT_TENURE = 0.5       # person_emp_length < 2
SCORECARD_TENURE_CUT = 2.0
SCORECARD_HIGH_INCOME = 0.8        # person_income > 100,000 (subtracted)
SCORECARD_INCOME_CUT = 100_000

# Dashboard sizes.
SCATTER_SAMPLE_ROWS = 2000
PREVIEW_ROWS = 500
TOP_FEATURES = 15
EXPLAIN_TOP_N = 5
EXPLAIN_RISK_TEXT = "Contributing factor toward higher predicted risk."
EXPLAIN_POSITIVE_TEXT = "Contributing factor toward lower predicted risk."
RECOMMENDATION_PAGE_PROBS = {"LOW": 0.15, "MEDIUM": 0.45, "HIGH": 0.75}

# Models: defaults of the three candidate learners.
LOGREG_MAX_ITER = 1000
LOGREG_TOL = 1e-6
FOREST_TREES = 200
FOREST_DEPTH = 12
FOREST_MIN_LEAF = 5
BOOST_ITERS = 300
BOOST_DEPTH = 6
BOOST_RATE = 0.05
BOOST_SUBSAMPLE = 0.8
BOOST_PENALTY = 1.0
BOOST_LEAST_CHILD = 1.0


# ---------------------------------------------------------------------------
# Tunables (execution only)
# ---------------------------------------------------------------------------

# Hash bits per class of the stratified split's bucket table (2^bits rows per class at most).
SPLIT_BUCKET_BITS = 16
# Classes of a label that a split or a fit accepts, and categories of a one-hot column.
SPLIT_MOST_CLASSES = 100
MOST_LEVELS = 1000
# Exact quantiles: marks that divide a window, values that the last window holds, windows at most.
QUANTILE_MARKS = 1024
QUANTILE_FEW = 4096
QUANTILE_MOST_WINDOWS = 100_000
