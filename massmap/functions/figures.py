"""Figures: which column a request reads, shares, and figures as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from massmap.functions.fixed_values import STATUS_LETTERS

MEASURES = ["tokens", "lines", "code_lines"]
ASPECTS = ["added", "removed", "churn", "net", "after"]
WEIGHT_COLUMNS = {
    ("tokens", "after"): "tokens", ("lines", "after"): "lines", ("code_lines", "after"): "code_lines",
    ("tokens", "added"): "added_tokens", ("lines", "added"): "added_lines", ("code_lines", "added"): "added_code_lines",
    ("tokens", "removed"): "removed_tokens", ("lines", "removed"): "removed_lines",
    ("code_lines", "removed"): "removed_code_lines", ("tokens", "churn"): "churn_tokens",
    ("lines", "churn"): "churn_lines", ("code_lines", "churn"): "churn_code_lines", ("tokens", "net"): "net_tokens",
    ("lines", "net"): "net_lines", ("code_lines", "net"): "net_code_lines",
}
SCAN_METRICS = ["name", "tokens", "lines", "code_lines", "comment_lines"]
DIFF_METRICS = ["name", "added", "removed", "churn", "net"]


def weight_column(measure: str, aspect: str) -> str:
    return WEIGHT_COLUMNS[(measure, aspect)]


def baseline_column(measure: str, aspect: str) -> str:
    """What a share divides by. Net is signed, so its whole is churn."""
    return weight_column(measure, "churn" if aspect == "net" else aspect)


def metric_for(metric: str, is_diff: bool) -> str:
    """The column a table may be sorted on in this mode, else its default."""
    return metric if metric in (DIFF_METRICS if is_diff else SCAN_METRICS) else ("net" if is_diff else "tokens")


def aspect_totals(added: Column, removed: Column, after: Column) -> dict[str, Column]:
    return {"added": added, "removed": removed, "net": added - removed, "churn": added + removed, "after": after}


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.least(F.lit(1.0), F.abs(part) / whole)).otherwise(0.0)


def comment_share(lines: Column, comment_lines: Column) -> Column:
    return F.when(lines > 0, comment_lines / lines).otherwise(0.0)


# --- figures as text -----------------------------------------------------------
def _tenths(value: Column) -> Column:
    """One decimal, rounded by the exact binary value, an exact half upwards.

    ``1.45`` is held a little below 1.45 and reads 1.4; ``1.25`` is held exactly
    and reads 1.3. The comparison with the half is exact in doubles.
    """
    size = value.cast("double")
    down = F.floor(size * 10)
    above_half = (size * 16 - (down * 2 + 1)) + size * 4 >= 0
    tenths = (down + F.when(above_half, 1).otherwise(0)).cast("bigint")
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def _whole(value: Column) -> Column:
    return F.floor(value + 0.5).cast("bigint").cast("string")


def heaviest_first(weight: Column) -> Column:
    """Twenty digits that sort as text from the largest 64-bit number down to the smallest."""
    return F.lpad((F.lit(2**63 - 1).cast("decimal(20,0)") - weight.cast("decimal(20,0)")).cast("string"), 20, "0")


def compact(value: Column) -> Column:
    """Three or four significant characters: 999, 1.0k, 9.9k, 10k, 1.2M."""
    size = F.abs(value)

    def scaled(number: Column, unit: str) -> Column:
        short = F.when(number < 9.95, _tenths(number)).otherwise(_whole(number))
        return F.concat(short, F.lit(unit))

    text = (
        F.when(size < 1000, size.cast("bigint").cast("string"))
        .when(size < 1_000_000, scaled(size / 1000, "k"))
        .otherwise(scaled(size / 1_000_000, "M"))
    )
    return F.when(value < 0, F.concat(F.lit("-"), text)).otherwise(text)


def signed(value: Column) -> Column:
    sign = F.when(value < 0, "-").otherwise("+")
    return F.when(value == 0, "0").otherwise(F.concat(sign, compact(F.abs(value))))


def share_text(value: Column) -> Column:
    percent = value * 100
    return (
        F.when(percent >= 99.5, "100%")
        .when(percent < 0.5, F.when(value > 0, "<1%").otherwise("0%"))
        .otherwise(F.concat(_whole(percent), F.lit("%")))
    )


def file_count(count: Column) -> Column:
    return F.when(count == 1, "1 file").otherwise(F.concat(compact(count), F.lit(" files")))


def change_text(added: Column, removed: Column) -> Column:
    """``+added -removed`` without a side that is nothing."""
    return F.concat_ws(
        " ",
        F.when(added > 0, F.concat(F.lit("+"), compact(added))),
        F.when(removed > 0, F.concat(F.lit("-"), compact(removed))),
    )


def relative_change(value: Column, before: Column, net: bool) -> Column:
    percent = F.concat(_tenths(F.abs(value / before) * 100), F.lit("%"))
    sign = F.when(value < 0, "-").when(value > 0, "+").otherwise("") if net else F.lit("")
    return F.when(before == 0, F.when(value == 0, "0.0%").otherwise("new")).otherwise(F.concat(sign, percent))


def ratio_text(ratio: Column) -> Column:
    """A ratio as a percentage with one decimal below ten percent."""
    value = ratio * 100
    return (
        F.when(value == 0, "0%")
        .when(value < 0.1, "<0.1%")
        .when(value < 10, F.concat(_tenths(value), F.lit("%")))
        .otherwise(F.concat(_whole(value), F.lit("%")))
    )


def grouped(value: Column) -> Column:
    return F.format_number(value, 0)


def signed_grouped(value: Column) -> Column:
    return F.when(value == 0, "0").otherwise(
        F.concat(F.when(value < 0, "-").otherwise("+"), grouped(F.abs(value)))
    )


def status_letter(status: Column) -> Column:
    chain = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, letter in STATUS_LETTERS.items():
        chain = chain.when(status == name, letter)
    return chain


def age(moment: Column, now: Column) -> Column:
    seconds = F.greatest(F.lit(0), F.unix_timestamp(now) - F.unix_timestamp(moment))

    def ago(unit: int, letter: str) -> Column:
        return F.concat(_whole(seconds / unit), F.lit(f"{letter} ago"))

    return (
        F.when(seconds < 45, "just now")
        .when(seconds < 3600, ago(60, "m"))
        .when(seconds < 86_400, ago(3600, "h"))
        .otherwise(ago(86_400, "d"))
    )


def run_length(milliseconds: Column) -> Column:
    seconds = F.greatest(F.lit(0), F.floor(milliseconds / 1000 + 0.5))
    return F.concat(F.floor(seconds / 60).cast("string"), F.lit(":"),
                    F.lpad((seconds % 60).cast("string"), 2, "0"))
