"""$variables in configured texts, replaced as whole tokens in one pass."""

from __future__ import annotations

import re
from collections.abc import Mapping
from datetime import date, datetime

MIN, MAX = datetime(1900, 1, 1), datetime(2999, 12, 31)


def expand(text: str | None, values: Mapping[str, object]) -> str | None:
    """``text`` with each $name that has a value replaced; longer names win, unknown ones stay."""
    if text is None:
        return None
    return re.sub(r"\$(\w+)", lambda m: _text(values[m[1]]) if m[1] in values and values[m[1]] is not None else m[0], text)


def _text(v: object) -> str:
    if isinstance(v, datetime):
        return v.strftime("%Y-%m-%d %H:%M:%S") if not v.microsecond else str(v)
    return str(v)


def of_run(run, spec, now: datetime | None = None) -> dict[str, object]:
    """Values for a run; bounds that aren't known are the outermost."""
    now = now or datetime.now()
    return {
        "load_id": run.load_id,
        "object_id": spec.object_id,
        "load_type": run.load.value,
        "extraction_type": run.extraction.value,
        "extraction_from": run.extraction_from or MIN,
        "extraction_to": run.extraction_to or MAX,
        "load_from": run.load_from or MIN,
        "load_to": run.load_to or MAX,
        "delta_from": MIN,
        "delta_to": MAX,
        "delta_field": spec.delta_field,
        "bdate_field": spec.bdate_field,
        "current_date": date(now.year, now.month, now.day),
        "now": now,
    }


def literals(text: str, values: Mapping[str, object]) -> str:
    """``text`` as SQL: times and dates become typed literals, unless they stand inside quotes already."""
    out, quoted = [], False
    for part in re.split(r"(')", text):
        if part == "'":
            quoted = not quoted
            out.append(part)
        elif quoted:
            out.append(expand(part, values))
        else:
            typed = {k: f"timestamp_ntz'{_text(v)}'" if isinstance(v, datetime) else f"date'{v}'" if isinstance(v, date) else v for k, v in values.items()}
            out.append(expand(part, typed))
    return "".join(out)
