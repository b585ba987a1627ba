"""Entity keys and event ids."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_FIELD = re.compile(r"\{(\w+)\}")


def template_fields(template: str) -> list[str]:
    return _FIELD.findall(template)


def from_template(template: str) -> Column:
    """``"bot:{bot_id}|user:{user_id}"`` filled from columns of those names; null if one of them is."""
    parts, at = [], 0
    for m in _FIELD.finditer(template):
        parts += [F.lit(template[at : m.start()]), F.col(m[1]).cast("string")]
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def joined(*parts: Column) -> Column:
    """Parts of a composite key with ``|`` between them."""
    return F.concat_ws("|", *parts)


def backfill_id(entity: Column, time: Column) -> Column:
    """A stable event id for an entity's hour, so that a backfill can be run again."""
    # The prefix, the separator, the time's format and the length.
    hour = F.date_format(F.date_trunc("hour", time), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return F.concat(F.lit("backfill:"), F.left(F.sha2(F.concat(entity, F.lit("|"), hour), 256), F.lit(32)))
