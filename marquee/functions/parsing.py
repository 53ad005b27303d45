"""Event-log line parsing as native column expressions (P-01 … P-06).

A log line is ``<time>,<user>,<request>``.  Watch requests look like
``GET /data/m/<title>/<minutes>.mpg``, ratings ``GET /rate/<title>=<1..5>``;
recommendation-request lines are a third kind that the parsers skip.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Request prefixes and the integer / ISO-time accept patterns.
WATCH_PREFIX = "GET /data/"
RATE_PREFIX = "GET /rate/"
REQUEST_MARKER = "recommendation request"
INT_PATTERN = r"^\s*[+-]?\d+\s*$"
ISO_TIME_PATTERN = (r"^(\d{4}-\d{2}-\d{2})(?:.(\d{2})(?::(\d{2})(?::(\d{2})"
                    r"(?:\.(\d{3}|\d{6}))?)?)?([+-]\d{2}:\d{2})?)?$")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def field(line, n: int) -> Column:
    """1-based comma field of a line ('' when absent)."""
    return F.split_part(_c(line), F.lit(","), F.lit(n))


def n_fields(line) -> Column:
    return F.size(F.split(_c(line), ",", -1))


def safe_int(text) -> Column:
    """Python ``int(text)``: optional sign and surrounding blanks, digits only."""
    t = _c(text)
    return F.when(t.rlike(INT_PATTERN), F.trim(t).try_cast("int"))


def iso_time(text) -> Column:
    """Strict ISO-8601 parse (date, optional one-char separator and time,
    3- or 6-digit fraction, optional offset which is dropped) → TIMESTAMP_NTZ.

    One pattern test, then the accepted shapes are told apart by length and
    padded to ``yyyy-MM-dd HH:mm:ss[.f]`` with substrings (no capture groups).
    """
    t = _c(text)
    core = F.regexp_replace(t, r"[+-]\d{2}:\d{2}$", "")
    n = F.length(core)

    def part(pos, need):
        return F.when(n >= need, F.substring(core, pos, 2)).otherwise(F.lit("00"))

    canon = F.concat(F.substring(core, 1, 10), F.lit(" "), part(12, 13), F.lit(":"), part(15, 16), F.lit(":"),
                     part(18, 19), F.when(n > 19, F.substring(core, 20, 7)).otherwise(F.lit("")))
    # Fast path for the usual full shape (seconds present, no offset): only the
    # separator needs replacing.
    tn = F.length(t)
    full = (tn.isin(19, 23, 26) & (F.substring(t, 14, 1) == ":") & (F.substring(t, 17, 1) == ":"))
    fast = F.concat(F.substring(t, 1, 10), F.lit(" "), F.substring(t, 12, 15))
    return F.when(t.rlike(ISO_TIME_PATTERN),
                  F.when(full, fast).otherwise(canon).try_cast("timestamp_ntz"))


def message_kind(line) -> Column:
    """P-03: watch / rate / request / other."""
    req = field(line, 3)
    return (F.when((n_fields(line) >= 3) & req.startswith(WATCH_PREFIX), F.lit("watch"))
            .when((n_fields(line) >= 3) & req.startswith(RATE_PREFIX), F.lit("rate"))
            .when(_c(line).contains(REQUEST_MARKER), F.lit("request"))
            .otherwise(F.lit("other")))


def parse_watch(lines: DataFrame, line_col: str = "line", keep=()) -> DataFrame:
    """P-01 stream parser, watch events; any failure drops the row.

    Output: ``updated_at`` TIMESTAMP_NTZ, ``user_id`` STRING (as in the log),
    ``movie_title_id`` STRING, ``watched_minutes`` INT.
    """
    line = F.col(line_col)
    req = field(line, 3)
    rest = F.split_part(req, F.lit("/data/"), F.lit(2))
    segs = F.split(rest, "/", -1)
    out = lines.select(
        *keep,
        iso_time(field(line, 1)).alias("updated_at"),
        field(line, 2).alias("user_id"),
        F.when(F.size(segs) >= 2, F.split_part(rest, F.lit("/"), F.lit(2))).alias("movie_title_id"),
        F.when(F.size(segs) >= 3,
               safe_int(F.split_part(F.split_part(rest, F.lit("/"), F.lit(3)), F.lit("."), F.lit(1)))
               ).alias("watched_minutes"),
        (n_fields(line) >= 3).alias("_ok"),
        req.startswith(WATCH_PREFIX).alias("_kind"),
    )
    return (out.where("_ok and _kind and updated_at is not null and movie_title_id is not null "
                      "and watched_minutes is not null")
               .drop("_ok", "_kind"))


def parse_rate(lines: DataFrame, line_col: str = "line", keep=()) -> DataFrame:
    """P-02 stream parser, rating events: title before the first ``=``, rating
    between the first and second ``=`` (later parts ignored)."""
    line = F.col(line_col)
    req = field(line, 3)
    rest = F.split_part(req, F.lit("/rate/"), F.lit(2))
    out = lines.select(
        *keep,
        iso_time(field(line, 1)).alias("updated_at"),
        field(line, 2).alias("user_id"),
        F.split_part(rest, F.lit("="), F.lit(1)).alias("movie_title_id"),
        F.when(F.size(F.split(rest, "=", -1)) >= 2,
               safe_int(F.split_part(rest, F.lit("="), F.lit(2)))).alias("rating"),
        (n_fields(line) >= 3).alias("_ok"),
        req.startswith(RATE_PREFIX).alias("_kind"),
    )
    return (out.where("_ok and _kind and updated_at is not null and rating is not null")
               .drop("_ok", "_kind"))


def parse_request(lines: DataFrame, line_col: str = "line", keep=()) -> DataFrame:
    """Recommendation-request lines: time, user, server, status, result, response ms.

    ``<time>,<user>,recommendation request <server>, status <code>, result: <list>, <n> ms``;
    the result list may itself contain commas, so the response time is the last field.
    """
    line = F.col(line_col)
    last = F.element_at(F.split(line, ",", -1), -1)
    body = F.regexp_extract(line, r"^[^,]*,[^,]*,(.*)$", 1)
    return (lines.where(line.contains(REQUEST_MARKER))
            .select(*keep,
                    iso_time(field(line, 1)).alias("updated_at"),
                    field(line, 2).alias("user_id"),
                    F.trim(F.regexp_extract(body, r"recommendation request ([^,]*)", 1)).alias("server"),
                    F.regexp_extract(body, r"status (\d+)", 1).try_cast("int").alias("status"),
                    F.regexp_extract(body, r"result: (.*), [^,]*$", 1).alias("result"),
                    F.regexp_extract(last, r"(\d+)", 1).try_cast("int").alias("response_ms")))


def parse_watch_csv(rows: DataFrame, keep=()) -> DataFrame:
    """P-04 batch parser over (timestamp, request_id, request): needs three path
    segments after ``/data/``; ``+`` becomes a space; minutes stay text."""
    rest = F.split_part(F.col("request"), F.lit("/data/"), F.lit(2))
    segs = F.split(rest, "/", -1)
    return (rows.where(F.col("request").startswith(WATCH_PREFIX) & (F.size(segs) >= 3))
            .select(*keep,
                    F.col("timestamp"),
                    F.col("request_id").alias("user_id"),
                    F.replace(F.split_part(rest, F.lit("/"), F.lit(2)), F.lit("+"), F.lit(" ")).alias("movie_title"),
                    F.split_part(F.split_part(rest, F.lit("/"), F.lit(3)), F.lit("."), F.lit(1)).alias("watched_minutes")))


def parse_rate_csv(rows: DataFrame, keep=()) -> DataFrame:
    """P-05 batch parser: exactly two ``=`` parts else dropped; rating stays text."""
    rest = F.split_part(F.col("request"), F.lit("/rate/"), F.lit(2))
    parts = F.split(rest, "=", -1)
    return (rows.where(F.col("request").startswith(RATE_PREFIX) & (F.size(parts) == 2))
            .select(*keep,
                    F.col("timestamp"),
                    F.col("request_id").alias("user_id"),
                    F.replace(parts[0], F.lit("+"), F.lit(" ")).alias("movie_title"),
                    parts[1].alias("rating")))


def lines_to_log_rows(lines: DataFrame, line_col: str = "line", keep=()) -> DataFrame:
    """Split a raw line into the 3-column log-CSV shape (extra fields dropped,
    as a 3-column CSV reader does)."""
    line = F.col(line_col)
    return lines.select(*keep, field(line, 1).alias("timestamp"),
                        field(line, 2).alias("request_id"),
                        F.when(n_fields(line) >= 3, field(line, 3)).alias("request"))


def encode_title(c) -> Column:
    """P-06: space → ``+`` (load side)."""
    return F.replace(_c(c), F.lit(" "), F.lit("+"))


def decode_title(c) -> Column:
    """P-06: ``+`` → space (parse / compare side)."""
    return F.replace(_c(c), F.lit("+"), F.lit(" "))
