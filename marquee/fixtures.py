"""Mapping from the driver's test tables to this domain's tables.

The same SQL text is used on the Spark side (temp views) and inside the DuckDB
oracle queries (as CTEs), so both engines start from identical inputs.
"""

from __future__ import annotations

from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders",
               "lineitem", "events", "documents", "embeddings", "pages",
               "benchmark", "labels", "conversations")

# Fixed mapping (portable Spark SQL / DuckDB SQL).
FIXTURE_SQL: dict[str, str] = {
    "fx_ratings": """
select o_custkey as user_id, l_partkey as movie_id,
       case when l_linenumber <= 5 then l_linenumber end as rating,
       l_shipdate as updated_at, l_orderkey, l_linenumber, l_suppkey, l_extendedprice
from lineitem join orders on l_orderkey = o_orderkey""",
    "fx_movies": """
select p_partkey as movie_id,
       concat(replace(p_name, ' ', '+'), '+', cast(p_partkey as string)) as movie_title_id,
       p_name as title, 1950 + p_size as year, r.rating as rating, r.votes as votes,
       split(case when p_partkey % 13 <> 0 then concat(p_type, ', ', replace(p_name, ' ', ', ')) end, ', ') as genres
from part left join (select movie_id, avg(rating) as rating, count(rating) as votes
                     from fx_ratings group by movie_id) r on p_partkey = r.movie_id""",
    "fx_watch": """
select event_id as watch_id, ts as updated_at, user_id,
       cast(regexp_extract(props, '[0-9]+', 0) as bigint) as movie_id,
       cast(floor(value) as int) as watched_minutes
from events where event_type <> 'error'""",
    "fx_log": """
select event_id, concat(substr(cast(ts as string), 1, 19), ',', cast(user_id as string), ',',
  case event_type
    when 'purchase' then concat('GET /rate/movie+', regexp_extract(props, '[0-9]+', 0), '=', cast(1 + event_id % 5 as string))
    when 'error' then concat('GET /data/m/movie+', regexp_extract(props, '[0-9]+', 0), '/bad.mpg')
    when 'signup' then concat('recommendation request host:8082, status 200, result: a+b, ', cast(cast(floor(value) as int) as string), ' ms')
    else concat('GET /data/m/movie+', regexp_extract(props, '[0-9]+', 0), '/', cast(cast(floor(value) as int) as string), '.mpg')
  end) as line
from events""",
    "fx_request": """
select event_id, user_id, ts, value as latency_ms,
       case when event_type = 'error' then 500 else 200 end as status,
       case when event_type = 'error' then 0 else cast(1 + event_id % 55 as int) end as n_items
from events""",
    "fx_topic": """
select cast(event_id % 4 as int) as part_id, cast(floor(event_id / 4) as bigint) as msg_offset, line
from fx_log""",
    "fx_user_factors": """
select u.user_id, dim, cast((u.user_id * 31 + dim * 17) % 101 as double) / 101 as value
from (select distinct user_id from fx_ratings) u cross join (select n_nationkey as dim from nation union all select n_nationkey + 25 from nation) d""",
    "fx_item_factors": """
select m.movie_id, dim, cast((m.movie_id * 13 + dim * 29) % 97 as double) / 97 as value
from fx_movies m cross join (select n_nationkey as dim from nation union all select n_nationkey + 25 from nation) d""",
}

FIXTURE_DEPS: dict[str, tuple[str, ...]] = {
    "fx_ratings": (),
    "fx_movies": ("fx_ratings",),
    "fx_watch": (),
    "fx_log": (),
    "fx_request": (),
    "fx_topic": ("fx_log",),
    "fx_user_factors": ("fx_ratings",),
    "fx_item_factors": ("fx_movies",),
    "fx_meta": (),
    "fx_times": (),
}

# Test mappings of our own (same portability rules as above).
# fx_meta: text-typed movie metadata rows (the enrichment CSV) carrying the
# messy values the loader must clean: N/A variants, blanks, fractional years,
# list literals, bad brackets, trailing commas.
FIXTURE_SQL["fx_meta"] = """
select concat('tt', lpad(cast(p_partkey as string), 7, '0')) as movie_id,
       concat(replace(p_name, ' ', '+'), '+', cast(p_partkey as string)) as movie_title_id,
       p_name as title,
       case p_partkey % 6 when 0 then 'N/A' when 1 then '  ' when 2 then concat(cast(1950 + p_size as string), '.5')
            when 3 then 'n/a' else cast(1950 + p_size as string) end as year,
       case when p_partkey % 9 = 0 then ' N/A ' else concat(cast(p_size % 10 as string), '.', cast(p_partkey % 10 as string)) end as rating,
       case when p_partkey % 13 <> 0 then concat(p_type, ', ', replace(p_name, ' ', ', '),
            case when p_partkey % 5 = 0 then ' ,' else '' end) end as genres,
       concat('A ', p_name, ' story::', p_brand) as plot,
       case p_partkey % 4 when 0 then concat('[''', cast(60 + p_size as string), ''']')
            when 1 then cast(60 + p_size as string) when 2 then '[''x'']' else '[]' end as runtime,
       concat(p_brand, ', Director ', cast(p_partkey % 10 as string)) as directors,
       concat('Actor ', cast(p_partkey % 17 as string), ' , Actor ', cast(p_partkey % 19 as string)) as actors_text,
       cast(p_size * 3 as string) as votes,
       case p_partkey % 3 when 0 then '[''English'', ''French'']' when 1 then ' French ' else '[oops]' end as languages,
       case p_partkey % 3 when 0 then '[''Canada'', ''United Kingdom'']' when 1 then 'USA' else '[oops' end as country,
       concat(cast(1950 + p_size as string), '-0', cast(1 + p_partkey % 9 as string), '-1', cast(p_partkey % 9 as string)) as release_date,
       concat('https://img/', cast(p_partkey as string), '.jpg') as poster
from part"""

# fx_times: event times rendered as text in the shapes a log may carry.
FIXTURE_SQL["fx_times"] = """
select event_id,
       case event_id % 5 when 0 then substr(cast(ts as string), 1, 19)
            when 1 then replace(substr(cast(ts as string), 1, 19), ' ', 'T')
            when 2 then substr(cast(ts as string), 1, 10)
            when 3 then substr(cast(ts as string), 1, 23)
            else concat('bad-', cast(event_id as string)) end as time_text
from events"""


def _closure(names) -> list[str]:
    order: list[str] = []

    def visit(n):
        for d in FIXTURE_DEPS[n]:
            visit(d)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    return order


def cte(*names: str, extra: str = "") -> str:
    """``WITH`` prefix defining the named fixture views (and their inputs).

    ``extra`` is appended as further CTE definitions (``a AS (...), ...``).
    """
    parts = [f"{n} AS ({FIXTURE_SQL[n].strip()})" for n in _closure(names)]
    if extra.strip():
        parts.append(extra.strip())
    return ("WITH " + ",\n".join(parts) + "\n") if parts else ""


# Mapped views that stand for the stored domain tables (ratings, movies, watch
# history, the raw log, the request log) and stored model factors.  They are written once per session as
# Parquet under the shared checkpoint folder and read back: scans
# keep column pruning and filter pushdown, and queries
# do not redo the mapping join.  The remaining views are cheap projections.
MATERIALIZED = ("fx_ratings", "fx_movies", "fx_watch", "fx_log", "fx_request",
                "fx_user_factors", "fx_item_factors")
# Of those, the ones produced by row-wise mapping of a single (large) input (the rest
# already come out of an aggregate / shuffle with many partitions).  A small input, whose
# scan has fewer splits than there are cores, is dealt round-robin to all cores before it is
# written; a large one is split by its scan and is not sorted and shuffled whole once more.
SPREAD = {"fx_ratings": "lineitem", "fx_watch": "events", "fx_log": "events", "fx_request": "events"}


def dealt(df: DataFrame, source: DataFrame) -> DataFrame:
    """``df`` dealt to all cores if the scan of its ``source`` has fewer splits than that."""
    cores = max(1, df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(cores) if source.rdd.getNumPartitions() < cores else df


# Measured (shuffled) size up to which every partition of a join's smaller side is hashed.
HASHED_PARTITION = "64MB"


@contextmanager
def _hashed_joins(spark: SparkSession):
    """Let AQE hash the smaller side of a join whose partitions it has measured to be small, so
    that neither side is sorted (a large one spills there)."""
    key = "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold"
    before = spark.conf.get(key, None)
    spark.conf.set(key, HASHED_PARTITION)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


class Tables:
    """The driver tables of one scale-factor folder plus the mapped views.

    Views are registered once per (session, folder); each attribute returns a
    lazily planned DataFrame, so nothing is read until an action runs.
    """

    _registered: dict[tuple[int, str], set] = {}
    load_seconds: dict[str, float] = {}

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._key = (id(spark), self.sf_dir)
        if self._key not in Tables._registered:
            for t in BASE_TABLES:
                spark.read.parquet(f"{self.sf_dir}/{t}.parquet").createOrReplaceTempView(t)
            for n in _closure(FIXTURE_SQL):
                spark.sql(FIXTURE_SQL[n]).createOrReplaceTempView(n)
            Tables._registered.clear()
            Tables._registered[self._key] = set()

    def _stored(self, name: str) -> DataFrame:
        """A materialised mapped table: written on first use in this session
        (its inputs first), then read from Parquet."""
        done = Tables._registered[self._key]
        if name not in done:
            import time

            from .session import scratch_path
            for dep in FIXTURE_DEPS[name]:
                if dep in MATERIALIZED:
                    self._stored(dep)
            t0 = time.time()
            path = scratch_path(self.spark, name)
            df = self.spark.sql(FIXTURE_SQL[name])
            if name in SPREAD:
                df = dealt(df, self.spark.table(SPREAD[name]))
            with _hashed_joins(self.spark) if name == "fx_ratings" else nullcontext():
                df.write.parquet(path)
            self.spark.read.parquet(path).createOrReplaceTempView(name)
            done.add(name)
            Tables.load_seconds[name] = time.time() - t0
        return self.spark.table(name)

    def materialize_all(self) -> None:
        """Write every mapped table.  Tables whose inputs are ready are written
        concurrently (independent Spark jobs from a few driver threads), wave
        by wave along the dependencies."""
        from concurrent.futures import ThreadPoolExecutor

        done = Tables._registered[self._key]
        pending = [n for n in MATERIALIZED if n not in done]
        with ThreadPoolExecutor(max_workers=4) as pool:
            while pending:
                ready = [n for n in pending
                         if all(d in done or d not in MATERIALIZED for d in FIXTURE_DEPS[n])]
                list(pool.map(self._stored, ready))
                pending = [n for n in pending if n not in ready]

    def table(self, name: str) -> DataFrame:
        return self.spark.table(name)

    def __getattr__(self, name: str) -> DataFrame:
        if name in ("ratings", "movies", "watch", "log", "request", "topic",
                    "user_factors", "item_factors", "meta", "times"):
            name = "fx_" + name
        if name in MATERIALIZED:
            return self._stored(name)
        if name in BASE_TABLES or name in FIXTURE_SQL:
            return self.spark.table(name)
        raise AttributeError(name)
