"""Identifiers and canonical texts."""

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_time(ts: Column | str) -> Column:
    """UTC time as 2024-01-02T03:04:05+00:00, with six decimals if there are any; the session's zone must be UTC."""
    t = F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp")
    whole = F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")
    rest = F.unix_micros(t) % 1_000_000
    return F.concat(whole, F.when(rest == 0, "").otherwise(F.concat(F.lit("."), F.lpad(rest.cast("string"), 6, "0"))), F.lit("+00:00"))


def locations(files: Column | str) -> Column:
    """`path:line` of each file, sorted, with commas between; a missing line leaves nothing behind the colon."""
    return F.array_join(F.array_sort(F.transform(files, lambda f: F.concat(f["path"], F.lit(":"), F.coalesce(f["line"].cast("string"), F.lit(""))))), ",")


def evidence_id(parts: Sequence[Column]) -> Column:
    """ev_ and 16 hex digits of the SHA-1 of the parts with `|` between; null parts are empty."""
    key = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit("ev_"), F.substr(F.sha1(F.encode(key, "UTF-8")), F.lit(1), F.lit(16)))


def case_id(repo: str, sha: str, component: str) -> Column:
    return F.concat(F.col(repo), F.lit("@"), F.substr(sha, F.lit(1), F.lit(12)), F.lit(":"), F.col(component))


def feature_column(source: str, evidence_type: str) -> Column:
    return F.concat(F.lower(source), F.lit("_"), F.col(evidence_type))
