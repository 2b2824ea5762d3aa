"""Column -> Column helpers."""

from reelsift.functions.dates import (epoch_month, epoch_to_ts, epoch_year, in_range,  # noqa: F401
                                      month_start, week_start)
from reelsift.functions.labels import (clip, pct, rescale_vote, reward_label,  # noqa: F401
                                       segment_label)
from reelsift.functions.text import (contains_literal, needs_article_fix, normalize_spaces,  # noqa: F401
                                     normalize_tag, release_year, split_genres, strip_punct,
                                     strip_year_suffix, swap_leading_article, tag_clean,
                                     title_append_year, title_article_fix, title_norm_basic,
                                     title_norm_plain, title_norm_strict, title_year,
                                     title_year_strict, ustrip)
