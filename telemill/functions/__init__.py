"""Column-expression helpers (all JVM-side, codegen friendly)."""

from telemill.functions.exprs import (  # noqa: F401
    epoch_us, ts_text, minute_text, nan_to_null, null_if_token, fence_body,
    strip_ws, non_blank, fixed, round1, thousands,
)
