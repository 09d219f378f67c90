from riverspark.functions.aggregates import (
    missing_count,
    row_count,
    strict_avg,
    strict_sum,
    weighted_avg,
)
from riverspark.functions.scalars import (
    CFS_TO_M3S,
    KELVIN_OFFSET,
    METRES_TO_MM,
    UTC_MINUS,
    convert,
    epoch_to_timestamp,
    glue_label,
    jday_to_date,
    local_timestamp,
    mid_month,
    pad_hour,
    pattern_class,
    percent_change,
    recode,
    repair_exponent,
    sentence_case,
    split_composite,
    threshold_class,
    utc_minus,
    utc_timestamp,
    variable_from_source,
)

__all__ = [
    "CFS_TO_M3S",
    "KELVIN_OFFSET",
    "METRES_TO_MM",
    "UTC_MINUS",
    "convert",
    "epoch_to_timestamp",
    "glue_label",
    "jday_to_date",
    "local_timestamp",
    "mid_month",
    "missing_count",
    "pad_hour",
    "pattern_class",
    "percent_change",
    "recode",
    "repair_exponent",
    "row_count",
    "sentence_case",
    "split_composite",
    "strict_avg",
    "strict_sum",
    "threshold_class",
    "utc_minus",
    "utc_timestamp",
    "variable_from_source",
    "weighted_avg",
]
