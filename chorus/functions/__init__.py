from chorus.functions.columns import (  # noqa: F401
    NO_ESCAPE,
    as_of_col,
    blank_to_null,
    contains_ci,
    has_visible_text,
    iso_text,
    js_or,
    log_preview,
    lookback,
    map_lookup,
    upper_words,
)
