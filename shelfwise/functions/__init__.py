from shelfwise.functions.numeric import (
    count_if,
    flag,
    lit,
    modal,
    num,
    order_case,
    pct,
    presented,
    round_half_up,
    safe_div,
    select_list,
    sql,
    sum_if,
)

__all__ = [
    "count_if", "flag", "lit", "modal", "num", "order_case", "pct", "presented", "round_half_up",
    "safe_div", "select_list", "sql", "sum_if",
]
