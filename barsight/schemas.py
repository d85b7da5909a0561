"""Column contracts of the tables that flow between operators."""

from pyspark.sql import types as T


def _struct(**fields):
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_L, _I, _D, _S = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType()

BARS = _struct(session=_L, bar_ix=_I, open=_D, high=_D, low=_D, close=_D)
HEADLINES = _struct(session=_L, bar_ix=_I, headline=_S)
SENTIMENTS = _struct(
    session=_L,
    bar_ix=_I,
    headline=_S,
    company=_S,
    granular_sector=_S,
    sector=_S,
    sentiment=_S,
    sentiment_score=_D,
    confidence=_D,
)
LABELS = _struct(session=_L, close_half=_D, close_end=_D, R=_D)
PREDICTIONS = _struct(
    session=_L, mu=_D, p_up=_D, q_lower=_D, q_median=_D, q_upper=_D, u=_D
)
SUBMISSION = _struct(session=_L, target_position=_D)

PREDICTION_COLUMNS = [f.name for f in PREDICTIONS.fields]

DECISION_BAR = 49
END_BAR = 99
FIRST_HALF_LAST_BAR = 24
SHARPE_FACTOR = 16.0

EMISSION_COLUMNS = [
    "r",
    "oc",
    "hl",
    "co_level",
    "rvol_3",
    "rvol_5",
    "upper_wick",
    "lower_wick",
    "body_frac",
    "range_pos",
]
