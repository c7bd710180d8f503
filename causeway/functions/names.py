"""Column functions on the names found in a recording."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def plain_name(name: Column) -> Column:
    """The letters and digits of a name, in lower case, without a closing ``#12``; null for null.

    Blanks at the end are cut first, then the closing mark, then everything but ASCII letters and
    digits, so that spellings such as ``PollLeaseFrame``, ``poll::lease::frame`` and
    ``poll_lease_frame #36`` agree.
    """
    marked = F.regexp_replace(name, r"#[0-9]+\s*$", "")
    return F.lower(F.regexp_replace(marked, "[^A-Za-z0-9]", ""))
