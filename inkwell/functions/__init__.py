from inkwell.functions.buckets import TOPIC_BUCKETS, TOPIC_NAMES, bucket_sums
from inkwell.functions.formats import (
    iso_day,
    iso_micros,
    iso_seconds,
    joined,
    lag_minutes,
    minutes_label,
    thousands,
)
from inkwell.functions.windows import range_label, resolve_window, validate_range

__all__ = [
    "TOPIC_BUCKETS", "TOPIC_NAMES", "bucket_sums", "iso_day", "iso_micros", "iso_seconds",
    "joined", "lag_minutes", "minutes_label", "thousands", "range_label", "resolve_window",
    "validate_range",
]
