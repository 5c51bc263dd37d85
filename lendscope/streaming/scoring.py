"""Scoring a stream of applications with the batch operators.

Risk levels, scorecard probabilities, label lookups and top-n recommendations
are row-local projections, so the same functions apply unchanged to a
streaming DataFrame (``spark.readStream``); no state, watermark or shuffle is
involved. This module only wires them for a stream; it adds no operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendscope import settings as S
from lendscope.functions.columns import sigmoid
from lendscope.operators import products as K
from lendscope.operators import segments as J
from lendscope.operators.scorecard import scorecard_logit
from lendscope.operators.scoring import with_risk


def score_applications(stream: DataFrame, labels: dict[int, str] | None = None,
                       centroids=None, space=None, top_n: int = S.DEFAULT_TOP_N) -> DataFrame:
    """Scorecard probability, risk level, optional segment + label, and top-n products per row."""
    out = with_risk(stream, sigmoid(scorecard_logit()))
    if centroids is not None and space is not None:
        out = J.assign_nearest(out, space, centroids)
        out = J.attach_labels(out, labels or {})
    else:
        out = out.withColumn("segment_label", F.lit(S.UNKNOWN_SEGMENT))
    keys = [c for c in ("loan_id", "default_prob", "risk_level", "risk_score", "segment_label") if c in out.columns]
    return K.recommend_top_n(out, keys, top_n=top_n)
