from cardloom.plans.skew import (  # noqa: F401
    islands, mode_per, ordinal, previous_value, running_sum, top_k,
)
