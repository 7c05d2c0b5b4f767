from loyalframe.functions.exprs import (  # noqa: F401
    col,
    customer_kind,
    days_from_minutes,
    idiv,
    minute_text,
    minutes_between,
    month_text,
    pct,
    phase_of_month,
    ratio,
    round_div,
    week_ending,
)
