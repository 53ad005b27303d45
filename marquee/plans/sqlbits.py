"""DuckDB SQL fragments mirroring the column expressions (oracle side only)."""

from __future__ import annotations

from ..functions.parsing import INT_PATTERN, ISO_TIME_PATTERN


def safe_int(x: str) -> str:
    return f"(case when regexp_matches({x}, '{INT_PATTERN}') then try_cast(trim({x}) as integer) end)"


def iso_time(x: str) -> str:
    p = ISO_TIME_PATTERN

    def g(i):
        return f"regexp_extract({x}, '{p}', {i})"

    def part(i):
        return f"coalesce(nullif({g(i)}, ''), '00')"

    canon = (f"concat({g(1)}, ' ', {part(2)}, ':', {part(3)}, ':', {part(4)}, "
             f"case when {g(5)} <> '' then concat('.', {g(5)}) else '' end)")
    return f"(case when regexp_matches({x}, '{p}') then try_cast({canon} as timestamp) end)"


def field(line: str, n: int) -> str:
    return f"split_part({line}, ',', {n})"


def nfields(line: str) -> str:
    return f"len(string_split({line}, ','))"


def nparts(x: str, sep: str) -> str:
    return f"len(string_split({x}, '{sep}'))"


# Parsed watch and rating rows from fx_log (P-01, P-02), as CTE bodies.
WATCH_PARSED = f"""
select event_id, updated_at, user_id, movie_title_id, watched_minutes from (
  select event_id, {iso_time(field('line', 1))} as updated_at, {field('line', 2)} as user_id,
         split_part(rest, '/', 2) as movie_title_id,
         {safe_int("split_part(split_part(rest, '/', 3), '.', 1)")} as watched_minutes,
         {nfields('line')} >= 3 and starts_with({field('line', 3)}, 'GET /data/') and {nparts('rest', '/')} >= 3 as ok
  from (select event_id, line, split_part({field('line', 3)}, '/data/', 2) as rest from fx_log))
where ok and updated_at is not null and watched_minutes is not null"""

RATE_PARSED = f"""
select event_id, updated_at, user_id, movie_title_id, rating from (
  select event_id, {iso_time(field('line', 1))} as updated_at, {field('line', 2)} as user_id,
         split_part(rest, '=', 1) as movie_title_id,
         case when {nparts('rest', '=')} >= 2 then {safe_int("split_part(rest, '=', 2)")} end as rating,
         {nfields('line')} >= 3 and starts_with({field('line', 3)}, 'GET /rate/') as ok
  from (select event_id, line, split_part({field('line', 3)}, '/rate/', 2) as rest from fx_log))
where ok and updated_at is not null and rating is not null"""

LOG_ROWS = f"""
select event_id, {field('line', 1)} as "timestamp", {field('line', 2)} as request_id,
       case when {nfields('line')} >= 3 then {field('line', 3)} end as request
from fx_log"""

KIND = f"""(case when {nfields('line')} >= 3 and starts_with({field('line', 3)}, 'GET /data/') then 'watch'
      when {nfields('line')} >= 3 and starts_with({field('line', 3)}, 'GET /rate/') then 'rate'
      when contains(line, 'recommendation request') then 'request' else 'other' end)"""
