from ratelens.functions.columns import (
    existing_columns,
    numeric_columns,
    categorical_columns,
    require_columns,
)
from ratelens.functions.expr import (
    money_sum,
    money_avg,
    safe_ratio,
    any_true,
    first_word,
    label_ladder,
    null_inclusive_distinct,
)

__all__ = [
    "existing_columns",
    "numeric_columns",
    "categorical_columns",
    "require_columns",
    "money_sum",
    "money_avg",
    "safe_ratio",
    "any_true",
    "first_word",
    "label_ladder",
    "null_inclusive_distinct",
]
