"""Queries over feature pages, service descriptions and fetch plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from sourceworks.plans import fetch
from sourceworks.session import scratch_path
from sourceworks.sources import features as S
from sourceworks.streaming import pages as P
from sourcechecks.files import write_texts
from sourcechecks.inputs import given, sql
from sourcechecks.registry import query

# Pages of up to 500 features; x is a whole number so that its text is the same everywhere.
_PAGES = """select concat('page', event_id div 500) as path, to_json(named_struct('features', collect_list(named_struct(
        'attributes', named_struct('OID', event_id, 'KIND', event_type, 'PROPS', props, 'NONE', cast(null as string), 'X', 'attribute'),
        'geometry', {geometry})))) as body
    from {events} group by event_id div 500"""


def _pages(spark, sf, geometry):
    return sql(spark, sf, _PAGES.replace("{geometry}", geometry))


@query(
    "feature_points",
    """select cast(event_id as varchar) as OID, event_type as KIND, props as PROPS, cast(null as varchar) as NONE,
              if(event_id % 4 = 0, 'attribute', cast(user_id as varchar)) as X,
              if(event_id % 4 = 0, null, cast(user_id * 2 as varchar)) as Y from events""",
)
def feature_points(spark, sf):
    pages = _pages(spark, sf, "if(event_id % 4 = 0, null, named_struct('x', user_id, 'y', user_id * 2))")
    return S.feature_rows(pages, ["OID", "KIND", "PROPS", "NONE", "X", "Y"], S.POINT)


@query(
    "feature_multipoints",
    """select cast(event_id as varchar) as OID, if(event_id % 4 = 0, null, '[[' || user_id || ',1],[2,' || event_id || ']]') as POINTS from events""",
)
def feature_multipoints(spark, sf):
    pages = _pages(spark, sf, "if(event_id % 4 = 0, null, named_struct('points', array(array(user_id, 1), array(2, event_id))))")
    return S.feature_rows(pages, ["OID", "POINTS"], S.MULTIPOINT)


@query(
    "feature_polygons",
    """select cast(event_id as varchar) as OID, '[[[' || user_id || ',1],[2,' || event_id || ']]]' as RINGS, event_type as KIND from events""",
)
def feature_polygons(spark, sf):
    pages = _pages(spark, sf, "named_struct('rings', array(array(array(user_id, 1), array(2, event_id))))")
    return S.feature_rows(pages, ["OID", "KIND", "RINGS"], S.POLYGON)


# Page files: every third page fails first, every fifth arrives twice, every seventh never.
_TRIES = """select concat(folder, '/page', n, '.json') as path, body from pages_to_write where n % 7 <> 6
    union all select concat(folder, '/page', n, '_try1.json'), '{"error":{"code":500}}' from pages_to_write where n % 3 = 0
    union all select concat(folder, '/page', n, '_try2.json'), body from pages_to_write where n % 5 = 0 and n % 7 <> 6"""


def _ingested(spark, sf):
    """Page files written from events and ingested by several batches."""
    folder, target = scratch_path(spark, "pages"), scratch_path(spark, "ingested")
    pages = _pages(spark, sf, "named_struct('x', user_id, 'y', user_id * 2)")
    pages = pages.selectExpr(f"'{folder}' as folder", "cast(substring(path, 5) as bigint) as n", "body")
    pages.createOrReplaceTempView("pages_to_write")
    write_texts(spark.sql(_TRIES))
    stream = P.ingest_pages(
        spark, folder, target, f"{target}_state", ["OID", "KIND", "X", "Y"], S.POINT, files_per_batch=100
    )
    stream.awaitTermination()
    return target


@query(
    "ingested_features",
    """select cast(event_id as varchar) as OID, event_type as KIND, cast(user_id as varchar) as X, cast(user_id * 2 as varchar) as Y
       from events where (event_id // 500) % 7 <> 6""",
)
def ingested_features(spark, sf):
    """Features of page files as one table, each page once."""
    return P.ingested(spark, _ingested(spark, sf))


@query(
    "missing_pages",
    """select distinct 'page' || (event_id // 500) as page, cast((event_id // 500) % 3 = 0 as bigint) as tries
       from events where (event_id // 500) % 7 = 6""",
)
def missing_pages(spark, sf):
    """Pages that never came, with their failed tries."""
    planned = given(spark, sf, "events").selectExpr("concat('page', event_id div 500) as page").distinct()
    return P.missing_pages(planned, P.page_ledger(spark, _ingested(spark, sf)))


@query(
    "page_files",
    "select 'page' || (event_id // 500) as page, count(*) as features from events group by 1",
)
def page_files(spark, sf):
    """Page files read at once."""
    folder = scratch_path(spark, "pages")
    pages = _pages(spark, sf, "named_struct('x', user_id, 'y', user_id * 2)")
    write_texts(pages.selectExpr(f"concat('{folder}/', path, '.json') as path", "body"))
    found = S.checked_pages(S.read_pages(spark, folder)).where("outcome = 'ok'")
    return found.select(P.page_of(F.col("path")).alias("page"), F.size("_page.features").cast("bigint").alias("features"))


@query(
    "page_outcomes",
    """select event_id, case event_type when 'error' then 'retry' when 'view' then 'fatal' else 'ok' end as outcome from events""",
)
def page_outcomes(spark, sf):
    pages = given(spark, sf, "events").select(
        "event_id",
        F.when(F.col("event_type") == "error", F.concat(F.lit('{"error":{"code":'), "event_id", F.lit("}}")))
        .when(F.col("event_type") == "view", F.lit('{"count":3}'))
        .otherwise(F.lit('{"features":[]}'))
        .alias("body"),
    )
    return S.checked_pages(pages).select("event_id", "outcome")


# Services: every customer, with all combinations of flags and geometry types.
_DESCRIPTIONS = """select concat('https://host/s/', c_custkey) as url, if(c_custkey % 9 = 0, null, c_custkey * 3) as count,
    to_json(named_struct('type', if(c_custkey % 2 = 0, 'TABLE', 'Feature Layer'), 'name', c_name,
        'maxRecordCount', if(c_custkey % 7 = 0, null, c_custkey % 2000 + 1),
        'supportsPagination', c_custkey % 3 = 0, 'supportsStatistics', true,
        'advancedQueryCapabilities', if(c_custkey % 2 = 0, named_struct('supportsPagination', c_custkey % 4 = 0), null),
        'geometryType', element_at(array('esriGeometryPoint', 'esriGeometryMultipoint', 'esriGeometryPolygon', 'esriGeometryPolyline'), cast(c_custkey % 4 + 1 as int)),
        'fields', array(named_struct('name', concat('ID', c_nationkey), 'type', if(c_custkey % 5 = 0, 'esriFieldTypeInteger', 'esriFieldTypeOID')),
            named_struct('name', 'Shape', 'type', 'x'), named_struct('name', 'G', 'type', 'esriFieldTypeGeometry'),
            named_struct('name', c_mktsegment, 'type', 'esriFieldTypeString')))) as body from {customer}"""


@query(
    "service_metadata",
    """select 'https://host/s/' || c_custkey as url, c_name as name, if(c_custkey % 9 = 0, -1, c_custkey * 3) as source_count,
              if(c_custkey % 2 = 0, 'TABLE', 'Feature Layer') as server_type,
              cast(if(c_custkey % 7 = 0, -1, c_custkey % 2000 + 1) as int) as max_record_count,
              if(c_custkey % 2 = 0, c_custkey % 4 = 0, c_custkey % 3 = 0) as pagination, c_custkey % 2 <> 0 as stats,
              ['esriGeometryPoint', 'esriGeometryMultipoint', 'esriGeometryPolygon', 'esriGeometryPolyline'][c_custkey % 4 + 1] as geometry_type,
              'ID' || c_nationkey || ',' || c_mktsegment || [',X,Y', ',POINTS', ',RINGS', ''][c_custkey % 4 + 1] as fields,
              if(c_custkey % 5 = 0, '', 'ID' || c_nationkey) as oid_field from customer""",
)
def service_metadata(spark, sf):
    described = S.service_metadata(sql(spark, sf, _DESCRIPTIONS))
    return described.withColumn("fields", F.array_join("fields", ","))


_SERVICES = """select concat('https://host/s/', c_custkey) as url, c_custkey % 97 as source_count,
    cast(case c_custkey % 5 when 0 then -1 when 1 then 20000 else c_custkey % 13 + 1 end as int) as max_record_count,
    c_custkey % 2 = 0 as pagination, if(c_custkey % 3 = 0, '', 'OID') as oid_field,
    if(c_custkey % 11 = 0, -1, c_custkey) as min_key, if(c_custkey % 11 = 0, -1, c_custkey + c_custkey % 50) as max_key,
    if(c_custkey % 4 = 0, 'TABLE', 'Layer') as server_type, 'esriGeometryPoint' as geometry_type from {customer}"""
_SIZED = f"""s as (select *, least(max_record_count, 10000) as page from ({_SERVICES.format(customer="customer")}) where max_record_count > 0)"""
_PAGED = "select s.*, r.i * page as start from s, range(0, 100) r(i) where pagination and r.i * page < source_count"
_RANGED = """select s.*, min_key + r.i * page as start from s, range(0, 100) r(i)
             where not pagination and oid_field <> '' and max_key <> -1 and min_key + r.i * page <= max_key"""


@query(
    "page_plan",
    f'with {_SIZED} select url, start as "offset", cast(page as bigint) as page_rows from ({_PAGED})',
)
def page_plan(spark, sf):
    return fetch.page_plan(sql(spark, sf, _SERVICES))


@query(
    "range_plan",
    f"with {_SIZED} select url, oid_field, start as low, start + page - 1 as high from ({_RANGED})",
)
def range_plan(spark, sf):
    return fetch.range_plan(sql(spark, sf, _SERVICES))


@query(
    "fetch_queries",
    f"""with {_SIZED}, geo as (select *, if(server_type = 'TABLE', '', '&geometryType=esriGeometryPoint&outSR=4269') || '&outFields=*&f=json' as tail from s)
        select p.url, p.start, p.url || '/query?where=1+%3D+1&resultOffset=' || p.start || '&resultRecordCount=' || p.page || tail as query
        from ({_PAGED}) p join geo on geo.url = p.url
        union all select p.url, p.start, p.url || '/query?where=OID+>%3D+' || p.start || '+and+OID+<%3D+' || (p.start + p.page - 1) || tail
        from ({_RANGED}) p join geo on geo.url = p.url""",
)
def fetch_queries(spark, sf):
    return fetch.fetch_queries(sql(spark, sf, _SERVICES))
