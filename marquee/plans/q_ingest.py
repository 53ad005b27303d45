"""Registered queries: log parsing, scans, cleaning, loads (S, P, K rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import Tables, cte
from ..functions import cleaning, parsing
from ..session import scratch_path
from ..sources import catalog, files, loaders
from ..operators import dimensions
from . import sqlbits as B
from .registry import query

AS_OF = "2025-03-01 00:00:00"


def sq(s: str) -> str:
    """Quote a Python string as a SQL literal."""
    return "'" + s.replace("'", "''") + "'"


# --------------------------------------------------------------- log parsing
@query("parse_watch", cte("fx_log", extra=f"w AS ({B.WATCH_PARSED})") + "select * from w")
def q_parse_watch(spark, sf):
    return parsing.parse_watch(Tables(spark, sf).log, keep=["event_id"])


@query("parse_rate", cte("fx_log", extra=f"r AS ({B.RATE_PARSED})") + "select * from r")
def q_parse_rate(spark, sf):
    return parsing.parse_rate(Tables(spark, sf).log, keep=["event_id"])


@query("route_messages", cte("fx_log") + f"select {B.KIND} as kind, count(*) as n_messages from fx_log group by 1")
def q_route_messages(spark, sf):
    log = Tables(spark, sf).log
    return log.groupBy(parsing.message_kind("line").alias("kind")).agg(F.count(F.lit(1)).alias("n_messages"))


_CSV_WATCH = f"""
select event_id, "timestamp", request_id as user_id, replace(split_part(rest, '/', 2), '+', ' ') as movie_title,
       split_part(split_part(rest, '/', 3), '.', 1) as watched_minutes
from (select *, split_part(request, '/data/', 2) as rest from ({B.LOG_ROWS}))
where starts_with(request, 'GET /data/') and {B.nparts('rest', '/')} >= 3"""

_CSV_RATE = f"""
select event_id, "timestamp", request_id as user_id, replace(split_part(rest, '=', 1), '+', ' ') as movie_title,
       split_part(rest, '=', 2) as rating
from (select *, split_part(request, '/rate/', 2) as rest from ({B.LOG_ROWS}))
where starts_with(request, 'GET /rate/') and {B.nparts('rest', '=')} = 2"""


@query("parse_watch_csv", cte("fx_log") + _CSV_WATCH)
def q_parse_watch_csv(spark, sf):
    rows = parsing.lines_to_log_rows(Tables(spark, sf).log, keep=["event_id"])
    return parsing.parse_watch_csv(rows, keep=["event_id"])


@query("parse_rate_csv", cte("fx_log") + _CSV_RATE)
def q_parse_rate_csv(spark, sf):
    rows = parsing.lines_to_log_rows(Tables(spark, sf).log, keep=["event_id"])
    return parsing.parse_rate_csv(rows, keep=["event_id"])


@query("title_codec", cte("fx_movies") + "select movie_id, replace(title, ' ', '+') as encoded, "
       "replace(movie_title_id, '+', ' ') as decoded from fx_movies")
def q_title_codec(spark, sf):
    m = Tables(spark, sf).movies
    return m.select("movie_id", parsing.encode_title("title").alias("encoded"),
                    parsing.decode_title("movie_title_id").alias("decoded"))


# --------------------------------------------------------------- file scans
def _log_file(spark, sf):
    path = scratch_path(spark, "log-text")
    files.write_text_lines(Tables(spark, sf).log, path)
    return path


@query("scan_log_csv", cte("fx_log") + "select \"timestamp\", request_id, request from ("
       + B.LOG_ROWS + ")")
def q_scan_log_csv(spark, sf):
    return files.scan_log_csv(spark, _log_file(spark, sf))


_WATCH_TEXT_COLS = ["watch_id", "updated_at", "user_id", "movie_id", "watched_minutes"]


def _watch_csv(spark, sf):
    path = scratch_path(spark, "watch-csv")
    w = Tables(spark, sf).watch
    loaders.write_csv(w.select([F.col(c).cast("string").alias(c) for c in _WATCH_TEXT_COLS]), path)
    return path


@query("scan_csv_header", cte("fx_watch") + "select " + ", ".join(
    f"cast({c} as varchar) as {c}" for c in _WATCH_TEXT_COLS) + " from fx_watch")
def q_scan_csv_header(spark, sf):
    return loaders.read_csv(spark, _watch_csv(spark, sf), _WATCH_TEXT_COLS)


@query("scan_csv_pruned", cte("fx_watch") + "select cast(user_id as bigint) as user_id, "
       "cast(movie_id as bigint) as movie_id from fx_watch")
def q_scan_csv_pruned(spark, sf):
    df = files.scan_csv_pruned(spark, _watch_csv(spark, sf), ["user_id", "movie_id"],
                               schema="watch_id string, updated_at string, user_id bigint, "
                                      "movie_id bigint, watched_minutes string")
    return df


@query("process_log_file", cte("fx_log", extra=f"w AS ({B.WATCH_PARSED}), r AS ({B.RATE_PARSED})")
       + "select 'data' as kind, updated_at, user_id, movie_title_id, watched_minutes as value from w "
         "union all select 'rate', updated_at, user_id, movie_title_id, rating from r")
def q_process_log_file(spark, sf):
    out = files.process_log_file(spark, _log_file(spark, sf))
    d = out["data"].select(F.lit("data").alias("kind"), "updated_at", "user_id", "movie_title_id",
                           F.col("watched_minutes").alias("value"))
    r = out["rate"].select(F.lit("rate").alias("kind"), "updated_at", "user_id", "movie_title_id",
                           F.col("rating").alias("value"))
    return d.unionByName(r)


@query("split_log_totals", cte("fx_log") + f"select (select count(*) from ({_CSV_WATCH})) as watch_rows, "
       f"(select count(*) from ({_CSV_RATE})) as rate_rows")
def q_split_log_totals(spark, sf):
    """K-06: parse the log CSV once, write two headed CSVs, report totals read back."""
    rows = files.scan_log_csv(spark, _log_file(spark, sf))
    base = scratch_path(spark, "split")
    paths = files.save_processed_data({"data": parsing.parse_watch_csv(rows),
                                       "rate": parsing.parse_rate_csv(rows)}, base)
    n = {k: loaders.read_csv(spark, p, ["timestamp"]).count() for k, p in paths.items()}
    return spark.createDataFrame([(n.get("data", 0), n.get("rate", 0))], "watch_rows long, rate_rows long")


# --------------------------------------------------------------- cleaning
def _clean_na(x):
    return f"(case when {x} is null or trim({x}) = '' or upper({x}) = 'N/A' then null else {x} end)"


def _safe_float(x):
    return f"(case when regexp_matches({x}, {sq(cleaning.FLOAT_PATTERN)}) then try_cast(trim({x}) as double) end)"


_RUNTIME_RE = r"^\[\s*['\"]?([^,'\"\]]*)['\"]?\s*(,.*)?\]$"


def _runtime(x):
    inner = f"regexp_extract({x}, {sq(_RUNTIME_RE)}, 1)"
    return (f"(case when starts_with({x}, '[') and ends_with({x}, ']') then "
            f"(case when regexp_matches({inner}, '^\\d+$') then try_cast({inner} as integer) end) "
            f"when regexp_matches({x}, '^\\d+$') then try_cast({x} as integer) end)")


_QUOTED_ITEM_RE = r"""['"]([^'"]*)['"]"""


def _list_literal(x):
    return (f"(case when {x} is null then null when starts_with({x}, '[') and ends_with({x}, ']') then "
            f"regexp_extract_all({x}, {sq(_QUOTED_ITEM_RE)}, 1) "
            f"else [trim({x})] end)")


@query("clean_na", cte("fx_meta") + f"select movie_id, {_clean_na('year')} as year, {_clean_na('rating')} as rating "
       "from fx_meta")
def q_clean_na(spark, sf):
    m = Tables(spark, sf).meta
    return m.select("movie_id", cleaning.clean_na("year").alias("year"), cleaning.clean_na("rating").alias("rating"))


@query("safe_numeric", cte("fx_meta") + f"select movie_id, {B.safe_int(_clean_na('year'))} as year, "
       f"{_safe_float(_clean_na('rating'))} as rating from fx_meta")
def q_safe_numeric(spark, sf):
    m = Tables(spark, sf).meta
    return m.select("movie_id", parsing.safe_int(cleaning.clean_na("year")).alias("year"),
                    cleaning.safe_float(cleaning.clean_na("rating")).alias("rating"))


def _explode_sql(list_expr_by_col: dict[str, str]) -> str:
    parts = []
    for col, expr in list_expr_by_col.items():
        parts.append(f"select movie_id, '{col}' as field, cast(unnest(generate_series(1, len(l))) as integer) as pos, "
                     f"unnest(l) as elem from (select movie_id, {expr} as l from fx_meta)")
    return " union all ".join(parts)


def _explode_spark(df, exprs: dict):
    out = None
    for col, expr in exprs.items():
        part = (df.select("movie_id", F.lit(col).alias("field"), F.posexplode(expr).alias("p", "elem"))
                .select("movie_id", "field", (F.col("p") + 1).cast("int").alias("pos"), "elem"))
        out = part if out is None else out.unionByName(part)
    return out


@query("split_list", cte("fx_meta") + _explode_sql({
    "genres": f"list_transform(string_split({_clean_na('genres')}, ','), lambda e: trim(e))",
    "directors": f"list_transform(string_split({_clean_na('directors')}, ','), lambda e: trim(e))",
    "actors": f"list_transform(string_split({_clean_na('actors_text')}, ','), lambda e: trim(e))"}))
def q_split_list(spark, sf):
    m = Tables(spark, sf).meta
    return _explode_spark(m, {"genres": cleaning.split_list(cleaning.clean_na("genres")),
                              "directors": cleaning.split_list(cleaning.clean_na("directors")),
                              "actors": cleaning.split_list(cleaning.clean_na("actors_text"))})


@query("parse_list_literal", cte("fx_meta") + _explode_sql({
    "languages": _list_literal(_clean_na("languages")), "country": _list_literal(_clean_na("country"))}))
def q_parse_list_literal(spark, sf):
    m = Tables(spark, sf).meta
    return _explode_spark(m, {"languages": cleaning.parse_list_literal(cleaning.clean_na("languages")),
                              "country": cleaning.parse_list_literal(cleaning.clean_na("country"))})


@query("parse_runtime", cte("fx_meta") + f"select movie_id, {_runtime(_clean_na('runtime'))} as duration from fx_meta")
def q_parse_runtime(spark, sf):
    m = Tables(spark, sf).meta
    return m.select("movie_id", cleaning.parse_runtime(cleaning.clean_na("runtime")).alias("duration"))


@query("parse_time_default", cte("fx_times") + f"select event_id, coalesce({B.iso_time('time_text')}, "
       f"timestamp '{AS_OF}') as updated_at from fx_times")
def q_parse_time_default(spark, sf):
    t = Tables(spark, sf).times
    return t.select("event_id", cleaning.time_or_default("time_text", AS_OF).alias("updated_at"))


def _reason_sql(value: str) -> str:
    ip = sq(parsing.INT_PATTERN)
    r = (f"(case when user_id is null or user_id = '' then 'missing_user_id' "
         f"when not regexp_matches(user_id, {ip}) then 'invalid_user_id' "
         f"when movie_title is null or movie_title = '' then 'missing_title' "
         f"when {value} is null or {value} = '' then 'missing_{value}' "
         f"when not regexp_matches({value}, {ip}) then 'invalid_{value}' ")
    if value == "rating":
        r += f"when not ({B.safe_int(value)} between 1 and 5) then 'rating_out_of_range' "
    return r + "end)"


def _fact_rows(spark, sf, kind):
    """Text fact rows from the 3-column log CSV reading of every line: the
    matching lines give valid rows, the other kinds exercise the reject
    branches (missing title, bad minutes or rating)."""
    log = Tables(spark, sf).log
    rows = parsing.lines_to_log_rows(log, keep=["event_id"])
    val = "rating" if kind == "ratings" else "watched_minutes"
    prefix = "/rate/" if kind == "ratings" else "/data/"
    rest = F.split_part(F.col("request"), F.lit(prefix), F.lit(2))
    title = (F.split_part(rest, F.lit("="), F.lit(1)) if kind == "ratings"
             else F.split_part(rest, F.lit("/"), F.lit(2)))
    value = (F.split_part(rest, F.lit("="), F.lit(2)) if kind == "ratings"
             else F.split_part(F.split_part(rest, F.lit("/"), F.lit(3)), F.lit("."), F.lit(1)))
    return rows.select("event_id", "timestamp", F.col("request_id").alias("user_id"),
                       parsing.decode_title(title).alias("movie_title"), value.alias(val))


def _fact_rows_sql(kind):
    if kind == "ratings":
        return (f"select event_id, \"timestamp\", request_id as user_id, replace(split_part(rest, '=', 1), '+', ' ') as movie_title, "
                f"split_part(rest, '=', 2) as rating from (select *, split_part(request, '/rate/', 2) as rest from ({B.LOG_ROWS}))")
    return (f"select event_id, \"timestamp\", request_id as user_id, replace(split_part(rest, '/', 2), '+', ' ') as movie_title, "
            f"split_part(split_part(rest, '/', 3), '.', 1) as watched_minutes "
            f"from (select *, split_part(request, '/data/', 2) as rest from ({B.LOG_ROWS}))")


@query("validate_rows", cte("fx_log", extra=f"fr AS ({_fact_rows_sql('watch_history')})")
       + f"select {_reason_sql('watched_minutes')} as reject_reason, count(*) as n_rows from fr group by 1")
def q_validate_rows(spark, sf):
    rows = loaders.validate_fact_rows(_fact_rows(spark, sf, "watch_history"), "watch_history")
    return rows.groupBy("reject_reason").agg(F.count(F.lit(1)).alias("n_rows"))


@query("rating_range", cte("fx_ratings") + "select (rating is null or rating between 1 and 5) as accepted, "
       "count(*) as n_rows from fx_ratings group by 1")
def q_rating_range(spark, sf):
    r = Tables(spark, sf).ratings
    return r.groupBy(cleaning.rating_in_range("rating").alias("accepted")).agg(F.count(F.lit(1)).alias("n_rows"))


@query("null_filters", cte("fx_movies", "fx_watch") +
       "select 'movies_rated' as filter, count(*) as n_rows from fx_movies where rating is not null and votes is not null "
       "union all select 'movies_with_genres', count(*) from fx_movies where genres is not null "
       "union all select 'watch_with_minutes', count(*) from fx_watch where watched_minutes is not null")
def q_null_filters(spark, sf):
    t = Tables(spark, sf)
    parts = [("movies_rated", t.movies.where(F.col("rating").isNotNull() & F.col("votes").isNotNull())),
             ("movies_with_genres", t.movies.where(F.col("genres").isNotNull())),
             ("watch_with_minutes", t.watch.where(F.col("watched_minutes").isNotNull()))]
    out = None
    for name, df in parts:
        c = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("filter"), "n_rows")
        out = c if out is None else out.unionByName(c)
    return out


@query("dropna_subset", cte("fx_ratings") + "select user_id, movie_id, rating, updated_at, l_orderkey, l_linenumber "
       "from fx_ratings where rating is not null")
def q_dropna_subset(spark, sf):
    r = Tables(spark, sf).ratings
    return r.dropna(subset=["rating"]).select("user_id", "movie_id", "rating", "updated_at", "l_orderkey", "l_linenumber")


# --------------------------------------------------------------- loads
def _meta_csv(spark, sf, copies: int = 2):
    """The metadata rows written twice (in-batch duplicates) as the header CSV."""
    m = Tables(spark, sf).meta.withColumnRenamed("actors_text", "cast")
    path = scratch_path(spark, "meta-csv")
    loaders.write_csv(m.unionByName(m) if copies == 2 else m, path)
    return path


def _arr_sql(x):
    return f"(case when {x} is null then null else array_to_string({x}, '|') end)"


def _arr_spark(c):
    return F.when(F.col(c).isNull(), F.lit(None)).otherwise(F.concat_ws("|", F.col(c)))


_MAP_SQL = f"""
select movie_id as imdb_id, movie_title_id, title,
       {B.safe_int(_clean_na('year'))} as year, {_safe_float(_clean_na('rating'))} as rating,
       {_arr_sql(f"list_transform(string_split({_clean_na('genres')}, ','), lambda e: trim(e))")} as genres,
       plot, {_runtime(_clean_na('runtime'))} as duration,
       {_arr_sql(f"list_transform(string_split({_clean_na('directors')}, ','), lambda e: trim(e))")} as directors,
       {_arr_sql(f"list_transform(string_split({_clean_na('actors_text')}, ','), lambda e: trim(e))")} as actors,
       {B.safe_int(_clean_na('votes'))} as votes,
       {_arr_sql(_list_literal(_clean_na('languages')))} as languages,
       {_arr_sql(_list_literal(_clean_na('country')))} as country,
       try_cast({_clean_na('release_date')} as date) as release_date, poster
from fx_meta"""

_ARRAY_COLS = ("genres", "directors", "actors", "languages", "country")


def _flat(df):
    return df.select([_arr_spark(c).alias(c) if c in _ARRAY_COLS else F.col(c) for c in df.columns])


@query("map_movie_columns", cte("fx_meta") + _MAP_SQL)
def q_map_movie_columns(spark, sf):
    m = Tables(spark, sf).meta.withColumnRenamed("actors_text", "cast")
    return _flat(cleaning.map_movie_columns(m))


@query("load_movies_csv", cte("fx_movies", "fx_meta", "fx_watch", extra=f"mapped AS ({_MAP_SQL}), "
       "existing AS (select movie_id, movie_title_id from fx_movies where movie_id in (select movie_id from fx_watch))")
       + "select (select max(movie_id) from existing) + cast(row_number() over (order by movie_title_id) as bigint) as movie_id, "
         "* from (select distinct * from mapped where movie_title_id not in (select movie_title_id from existing))")
def q_load_movies_csv(spark, sf):
    """S-05: every metadata row appears twice in the CSV; each title is new
    except where the movies table already holds it; one insert per title."""
    t = Tables(spark, sf)
    csv_df = loaders.read_csv(spark, _meta_csv(spark, sf), loaders_columns())
    new_rows, _ = loaders.load_movies_csv(csv_df, _existing_movies(t))
    return _flat(new_rows)


def _existing_movies(t):
    """Dimension state before the metadata load: the movies that watch events
    have already created."""
    watched = t.watch.select("movie_id").distinct()
    return t.movies.join(watched, "movie_id", "left_semi").select("movie_id", "movie_title_id")


def loaders_columns():
    from .. import schemas
    return schemas.MOVIE_METADATA_CSV_COLUMNS


@query("load_totals", cte("fx_movies", "fx_meta", "fx_watch", extra="existing AS (select movie_title_id from fx_movies "
       "where movie_id in (select movie_id from fx_watch))")
       + "select cast(count(*) filter (where movie_title_id not in (select movie_title_id from existing)) as bigint) as inserted, "
         "cast(count(*) filter (where movie_title_id not in (select movie_title_id from existing)) as bigint) as duplicate, "
         "cast(2 * count(*) filter (where movie_title_id in (select movie_title_id from existing)) as bigint) as already_present, "
         "cast(0 as bigint) as rejected from fx_meta")
def q_load_totals(spark, sf):
    """A-24: outcome counts of the metadata load (inserted / duplicate / present / rejected)."""
    t = Tables(spark, sf)
    csv_df = loaders.read_csv(spark, _meta_csv(spark, sf), loaders_columns())
    _, outcome = loaders.load_movies_csv(csv_df, _existing_movies(t))
    return outcome


# --------------------------------------------------------------- loads in input order
_ODD = "ascii(right(movie_title_id, 1)) % 2"
_INPUT_EXISTING = "existing AS (select movie_id, movie_title_id from fx_movies where movie_id in (select movie_id from fx_watch))"


def _meta_lines(spark, sf):
    """Headerless CSV lines in several files whose order decides the load: each title has two
    rows, the one titled ``zz …`` in front for even titles and behind for odd ones, and,
    ahead of both, a line with too many (even) or too few (odd) fields."""
    cols = loaders_columns()
    m = Tables(spark, sf).meta.withColumnRenamed("actors_text", "cast").select(*cols).withColumn("odd", F.expr(_ODD))
    line = lambda *names: F.to_csv(F.struct(*names), {k: v for k, v in loaders.CSV_OPTIONS.items() if k != "header"})
    variants = [
        m.select("movie_title_id", F.col("odd").alias("ord"), "odd",
                 line(*[F.concat(F.lit("zz "), "title").alias("title") if c == "title" else c for c in cols]).alias("line")),
        m.select("movie_title_id", (1 - F.col("odd")).alias("ord"), "odd", line(*cols).alias("line")),
        m.select("movie_title_id", F.lit(-1).alias("ord"), "odd", F.when(F.col("odd") == 1, line(*cols[:2]))
                 .otherwise(F.concat(line(*cols), F.lit(",x"))).alias("line")),
    ]
    lines = variants[0].unionByName(variants[1]).unionByName(variants[2])
    path = scratch_path(spark, "meta-lines")
    # files are numbered by range, so their order by name is the sort order
    lines.repartitionByRange(6, "ord", "movie_title_id").sortWithinPartitions("ord", "movie_title_id").select("line").write.text(path)
    return path


@query("load_movies_input_order", cte("fx_movies", "fx_meta", "fx_watch", extra=f"mapped AS ({_MAP_SQL}), {_INPUT_EXISTING}")
       + "select (select max(movie_id) from existing) + cast(row_number() over (order by movie_title_id) as bigint) as movie_id, "
         f"* replace (case when {_ODD} = 0 then 'zz ' || title else title end as title) "
         "from mapped where movie_title_id not in (select movie_title_id from existing)")
def q_load_movies_input_order(spark, sf):
    """S-05 / J-12: of several rows with one title the first in the input wins, whatever its
    columns; lines with a wrong number of fields are rejected alone."""
    t = Tables(spark, sf)
    lines = loaders.read_csv_lines(spark, _meta_lines(spark, sf), loaders_columns(), header=False)
    new_rows, _ = loaders.load_movies_csv(lines, _existing_movies(t))
    return _flat(new_rows)


@query("load_totals_malformed", cte("fx_movies", "fx_meta", "fx_watch", extra=_INPUT_EXISTING
       + ", k AS (select movie_title_id in (select movie_title_id from existing) as present from fx_meta)")
       + "select count(*) filter (where not present) as inserted, count(*) filter (where not present) as duplicate, "
         "2 * count(*) filter (where present) as already_present, count(*) as rejected from k")
def q_load_totals_malformed(spark, sf):
    """A-24 over the same lines: malformed ones count as rejected."""
    t = Tables(spark, sf)
    lines = loaders.read_csv_lines(spark, _meta_lines(spark, sf), loaders_columns(), header=False)
    return loaders.load_movies_csv(lines, _existing_movies(t))[1]


def _fact_load_sql(kind):
    val = "rating" if kind == "ratings" else "watched_minutes"
    return f"""
fr AS ({_fact_rows_sql(kind)}),
ok AS (select cast({B.safe_int('user_id')} as bigint) as user_id, replace(movie_title, ' ', '+') as movie_title_id,
              {B.safe_int(val)} as {val}, coalesce({B.iso_time('"timestamp"')}, timestamp '{AS_OF}') as updated_at
       from fr where {_reason_sql(val)} is null),
newk AS (select (select max(movie_id) from fx_movies) + cast(row_number() over (order by movie_title_id) as bigint) as movie_id,
                movie_title_id from (select distinct movie_title_id from ok
                                     where movie_title_id not in (select movie_title_id from fx_movies))),
keys AS (select movie_id, movie_title_id from fx_movies union all select * from newk)"""


def _fact_csv(spark, sf, kind):
    path = scratch_path(spark, f"{kind}-csv")
    loaders.write_csv(_fact_rows(spark, sf, kind).drop("event_id"), path)
    val = "rating" if kind == "ratings" else "watched_minutes"
    return loaders.read_csv(spark, path, ["timestamp", "user_id", "movie_title", val])


@query("load_ratings_csv", cte("fx_movies", "fx_log", extra=_fact_load_sql("ratings"))
       + "select ok.user_id, keys.movie_id, ok.rating, ok.updated_at from ok join keys using (movie_title_id)")
def q_load_ratings_csv(spark, sf):
    t = Tables(spark, sf)
    load = loaders.load_fact_csv(_fact_csv(spark, sf, "ratings"), "ratings",
                                 t.movies.select("movie_id", "movie_title_id"),
                                 t.customer.select(F.col("c_custkey").alias("user_id")), AS_OF)
    return load.accepted


@query("load_watch_csv", cte("fx_movies", "fx_log", extra=_fact_load_sql("watch_history"))
       + "select ok.user_id, keys.movie_id, ok.watched_minutes, ok.updated_at from ok join keys using (movie_title_id)")
def q_load_watch_csv(spark, sf):
    t = Tables(spark, sf)
    load = loaders.load_fact_csv(_fact_csv(spark, sf, "watch_history"), "watch_history",
                                 t.movies.select("movie_id", "movie_title_id"),
                                 t.customer.select(F.col("c_custkey").alias("user_id")), AS_OF)
    return load.accepted


def _fact_rejects_sql(kind):
    val = "rating" if kind == "ratings" else "watched_minutes"
    return (f"select case when event_id % 5 < 2 then 'malformed_line' else coalesce({_reason_sql(val)}, 'accepted') end as outcome, "
            f"count(*) as n_rows from ({_fact_rows_sql(kind)}) group by 1")


def _fact_rejects(spark, sf, kind):
    """S-06 / S-07: lines per outcome of a load; of five lines one has a field too many and
    one lacks two."""
    val = "rating" if kind == "ratings" else "watched_minutes"
    cols = ["timestamp", "user_id", "movie_title", val]
    line = lambda *names: F.to_csv(F.struct(*names), {k: v for k, v in loaders.CSV_OPTIONS.items() if k != "header"})
    fifth = F.col("event_id") % 5
    path = scratch_path(spark, f"{kind}-lines")
    _fact_rows(spark, sf, kind).select(F.when(fifth == 0, F.concat(line(*cols), F.lit(",x"))).when(fifth == 1, line(*cols[:2]))
                                       .otherwise(line(*cols)).alias("line")).write.text(path)
    checked = loaders.validate_fact_rows(loaders.read_csv_lines(spark, path, cols, header=False), kind)
    return checked.groupBy(F.coalesce("reject_reason", F.lit("accepted")).alias("outcome")).agg(F.count(F.lit(1)).alias("n_rows"))


@query("load_ratings_rejects", cte("fx_movies", "fx_log") + _fact_rejects_sql("ratings"))
def q_load_ratings_rejects(spark, sf):
    return _fact_rejects(spark, sf, "ratings")


@query("load_watch_rejects", cte("fx_movies", "fx_log") + _fact_rejects_sql("watch_history"))
def q_load_watch_rejects(spark, sf):
    return _fact_rejects(spark, sf, "watch_history")


# --------------------------------------------------------------- dimensions
_PARSED_KEYS = f"""
w AS ({B.WATCH_PARSED}), r AS ({B.RATE_PARSED}),
facts AS (select user_id, movie_title_id from w union all select user_id, movie_title_id from r),
newk AS (select (select max(movie_id) from fx_movies) + cast(row_number() over (order by movie_title_id) as bigint) as movie_id,
                movie_title_id from (select distinct movie_title_id from facts
                                     where movie_title_id not in (select movie_title_id from fx_movies)))"""


def _parsed_facts(spark, sf):
    log = Tables(spark, sf).log
    w = parsing.parse_watch(log).select("user_id", "movie_title_id")
    r = parsing.parse_rate(log).select("user_id", "movie_title_id")
    return w.unionByName(r)


@query("resolve_movie_ids", cte("fx_movies", "fx_log", extra=_PARSED_KEYS) + "select * from newk")
def q_resolve_movie_ids(spark, sf):
    t = Tables(spark, sf)
    return dimensions.new_movie_keys(_parsed_facts(spark, sf), t.movies.select("movie_id", "movie_title_id"))


@query("upsert_users", cte("fx_ratings", "fx_watch")
       + "select distinct user_id from fx_ratings where user_id not in (select user_id from fx_watch)")
def q_upsert_users(spark, sf):
    """J-06: rating facts arrive; the users dimension holds the users that
    watch events created; the missing ones are inserted."""
    t = Tables(spark, sf)
    return dimensions.upsert_users(t.ratings, t.watch.select("user_id").distinct())


@query("upsert_movies", cte("fx_ratings", "fx_watch")
       + "select distinct movie_id, concat('unknown+', cast(movie_id as varchar)) as movie_title_id from fx_ratings "
         "where movie_id not in (select movie_id from fx_watch)")
def q_upsert_movies(spark, sf):
    """J-07: rating facts reference movies by id; the dimension holds the movies
    watch events created; missing ids get a unique placeholder title id."""
    t = Tables(spark, sf)
    return dimensions.upsert_movies(t.ratings, t.watch.select("movie_id").distinct())


@query("insert_if_absent", cte("fx_movies", "fx_meta", "fx_watch")
       + "select distinct movie_title_id, title from fx_meta where movie_title_id not in "
         "(select movie_title_id from fx_movies where movie_id in (select movie_id from fx_watch))")
def q_insert_if_absent(spark, sf):
    t = Tables(spark, sf)
    m = t.meta.select("movie_title_id", "title")
    batch = m.unionByName(m)
    return dimensions.insert_if_absent(batch, _existing_movies(t), "movie_title_id")


@query("append_facts", cte("fx_movies", "fx_log", extra=_PARSED_KEYS)
       + ", keys AS (select movie_id, movie_title_id from fx_movies union all select * from newk) "
         "select count(*) as rows_appended from r join keys using (movie_title_id)")
def q_append_facts(spark, sf):
    """K-03: resolve titles, append the rating rows to a table, return the count."""
    t = Tables(spark, sf)
    rates = parsing.parse_rate(t.log).withColumn("user_id", F.col("user_id").try_cast("bigint"))
    n, _ = catalog.append_facts(rates, t.movies, scratch_path(spark, "ratings-table"), "rating")
    return spark.createDataFrame([(n,)], "rows_appended long")
