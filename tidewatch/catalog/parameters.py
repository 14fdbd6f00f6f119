"""Fixed parameters of the catalog queries, shared with the check SQL.

The two regressions were fitted with `fit_entropy_model` on the sf0.1 tables: one on
20-row windows of `lineitem` per supplier, one on 5-row windows of the flow rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.operators.volumetric import EntropyModel

LINE_MODEL = EntropyModel(
    center=(2.862205481, 2.464205302, 8.192220216, 6.586381306, 6.07230777),
    scale=(0.355436356, 0.343066339, 1.953561074, 1.74236057, 1.640445164),
    weights=(-0.034788589, -0.007612305, 0.059580262, -0.045532359, 0.033945438),
    intercept=2.750164892,
)
LINE_MEAN = 0.248710706
LINE_SIGMA = 0.05

FLOW_MODEL = EntropyModel(
    center=(1.468340054, 1.468340054, 2.156022513, 1.993447282, 2.156022513),
    scale=(0.110720423, 0.110720423, 0.31289145, 0.31289145, 0.31289145),
    weights=(0.012310667, 0.001073143, -0.001730386, -0.013145478, 0.008640867),
    intercept=1.46843708,
)

# A stand-in for the classifier whose probabilities SQL can repeat: one logistic unit.
SCORE_BIAS = -2.5
SCORE_WEIGHTS = {
    "velocity": 1.5,
    "acceleration": 0.5,
    "iat_mean": 0.000004,
    "sa_ratio": 0.002,
    "jaccard_score": 4.0,
    "entropy_shannon": 0.4,
}


def logistic_score() -> Column:
    z = F.lit(SCORE_BIAS)
    for column, weight in SCORE_WEIGHTS.items():
        z = z + F.col(column) * F.lit(weight)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


HOST = "10.0.0.7"
TRUSTED = "10.0.0.8"
AS_OF = "2024-01-25 00:00:00"
LEDGER_UNTIL = "2024-01-12"
RETENTION_DAYS = 10
SPIKE_THRESHOLD = 1.2
DYNAMIC_SIZE = 20
