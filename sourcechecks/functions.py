"""Queries over column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from sourceworks.functions import names as N
from sourceworks.functions import sqlfuncs
from sourceworks.functions import values as V
from sourceworks.operators.changes import merged_map
from sourcechecks.inputs import derived, given, sql, with_tables
from sourcechecks.registry import query


def _name_sql(text: str) -> str:
    name = f"upper(regexp_replace(replace(regexp_replace({text}, '^\\s+|\\s+$', '', 'g'), '#', 'NUM'), '\\s+', '_', 'g'))"
    return f"left(regexp_replace(regexp_replace({name}, '[^A-Z0-9_]', '', 'g'), '^(\\d)', '_\\1'), 60)"


@query(
    "format_names",
    f"""with raw as (select p_partkey, concat('  ', p_size, if(p_partkey % 2 = 0, 'st ', ' # '), p_name, '. (', p_brand, ')  ') as header from part
                     union all select p_partkey, concat(p_name, '	 #', p_type, repeat('x', p_size)) from part)
        select p_partkey, header, {_name_sql("header")} as name from raw""",
)
def format_names(spark, sf):
    raw = sql(spark, sf, """select p_partkey, concat('  ', p_size, if(p_partkey % 2 = 0, 'st ', ' # '), p_name, '. (', p_brand, ')  ') as header from {part}
                            union all select p_partkey, concat(p_name, '\t #', p_type, repeat('x', p_size)) from {part}""")
    return raw.withColumn("name", N.column_name(F.col("header")))


@query(
    "file_loaders",
    """with f as (select o_orderkey, concat('f', o_orderkey, ['.csv', '.TXT', '.xlsx', '.mdb', '.dbf', '.tar.gz', ''][o_orderkey % 7 + 1]) as file_name from orders)
       select o_orderkey, file_name, lower(regexp_extract(file_name, '\\.([^.]+)$', 1)) as extension,
              case lower(regexp_extract(file_name, '\\.([^.]+)$', 1)) when 'csv' then 'Flat' when 'txt' then 'Flat'
              when 'xlsx' then 'Excel' when 'mdb' then 'MDB' when 'dbf' then 'DBF' end as loader from f""",
)
def file_loaders(spark, sf):
    files = sql(spark, sf, """select o_orderkey, concat('f', o_orderkey,
        array('.csv', '.TXT', '.xlsx', '.mdb', '.dbf', '.tar.gz', '')[cast(o_orderkey % 7 as int)]) as file_name from {orders}""")
    name = F.col("file_name")
    return files.withColumns({"extension": N.file_extension(name), "loader": N.loader_type(name)})


@query(
    "run_paths",
    with_tables(
        "runs sources",
        """select r.run_id, s.files_location || '/' || strftime(r.record_date, '%Y-%m-%d') || '/files' as files,
                  s.files_location || '/' || strftime(r.record_date, '%Y-%m-%d') || '/zip' as zip,
                  s.code || '_' || strftime(r.record_date, '%Y-%m-%d') as backup
           from runs r join sources s on r.ds_id = s.ds_id""",
    ),
)
def run_paths(spark, sf):
    runs = derived(spark, sf, "runs").join(derived(spark, sf, "sources"), "ds_id")
    base, date = F.col("files_location"), F.col("record_date")
    return runs.select(
        "run_id",
        N.run_files_location(base, date).alias("files"),
        N.run_zip_location(base, date).alias("zip"),
        N.backup_name(F.col("code"), date).alias("backup"),
    )


@query(
    "name_labels",
    """with raw as (select p_partkey, upper(left(p_name, 1)) || substr(replace(p_name, ' ', 'X'), 2) || p_brand as camel,
                           replace(p_name, ' ', '_') || '_' || p_size || 'mm' as snake from part)
       select p_partkey, camel, ltrim(lower(regexp_replace(camel, '([A-Z])', '_\\1', 'g')), '_') as snaked,
              array_to_string(list_transform(string_split(replace(snake, '_', ' '), ' '), lambda w: upper(left(w, 1)) || w[2:]), ' ') as label
       from raw""",
)
def name_labels(spark, sf):
    raw = sql(spark, sf, """select p_partkey, concat(upper(left(p_name, 1)), substr(replace(p_name, ' ', 'X'), 2), p_brand) as camel,
                                   concat(replace(p_name, ' ', '_'), '_', p_size, 'mm') as snake from {part}""")
    return raw.select("p_partkey", "camel", N.snake_case(F.col("camel")).alias("snaked"), N.display_label(F.col("snake")).alias("label"))


@query(
    "id_numbers",
    """select c_custkey, c_name, cast(nullif(regexp_extract(c_name, '\\d+'), '') as bigint) as number,
              'F' || c_custkey as file_id, string_split(c_name, '#')[-1] as tail from customer""",
)
def id_numbers(spark, sf):
    customers = given(spark, sf, "customer")
    return customers.select(
        "c_custkey",
        "c_name",
        N.id_number(F.col("c_name")).alias("number"),
        N.file_id(F.col("c_custkey")).alias("file_id"),
        N.url_file_name(F.replace("c_name", F.lit("#"), F.lit("/"))).alias("tail"),
    )


_BLANKS = """select conv_id, turn, case turn % 4 when 0 then null when 1 then '' when 2 then '  ' else role end as value,
        case turn % 3 when 0 then {empty} when 1 then {one} else {two} end as items from {conversations}"""


@query(
    "blank_checks",
    "with b as ("
    + _BLANKS.format(empty="[]", one="[role, null]", two="[role, ' ']", conversations="conversations")
    + """) select conv_id, turn, not regexp_matches(coalesce(value, 'x'), '^\\s*$') as filled,
            len(items) > 0 and len(list_filter(items, lambda i: regexp_matches(coalesce(i, 'x'), '^\\s*$'))) = 0 as items_filled,
            if(regexp_matches(value, '^\\s*$'), null, value) as cleaned from b""",
)
def blank_checks(spark, sf):
    rows = sql(spark, sf, _BLANKS.replace("{empty}", "cast(array() as array<string>)").replace("{one}", "array(role, null)")
               .replace("{two}", "array(role, ' ')"))
    value, items = F.col("value"), F.col("items")
    return rows.select(
        "conv_id", "turn", V.not_blank(value).alias("filled"), V.array_not_blank(items).alias("items_filled"),
        V.blank_to_null(value).alias("cleaned"),
    )


@query(
    "sql_checks",
    "with b as ("
    + _BLANKS.format(empty="[]", one="[role, null]", two="[role, ' ']", conversations="conversations")
    + """) select conv_id, turn, not regexp_matches(coalesce(value, 'x'), '^\\s*$') as filled,
            len(items) > 0 and len(list_filter(items, lambda i: regexp_matches(coalesce(i, 'x'), '^\\s*$'))) = 0 as items_filled from b""",
)
def sql_checks(spark, sf):
    sqlfuncs.register(spark)
    rows = sql(spark, sf, _BLANKS.replace("{empty}", "cast(array() as array<string>)").replace("{one}", "array(role, null)")
               .replace("{two}", "array(role, ' ')"))
    return rows.selectExpr(
        "conv_id", "turn", f"{sqlfuncs.NOT_BLANK}(value) as filled", f"{sqlfuncs.ARRAY_NOT_BLANK}(items) as items_filled"
    )


@query(
    "count_maps",
    """select event_id, event_id % 3 <> 1 as valid,
              if(event_id % 3 = 1, null, cast(json_extract_string(props, '$.k') as int)) as k from events""",
)
def count_maps(spark, sf):
    events = given(spark, sf, "events")
    text = F.when(F.col("event_id") % 3 == 1, '{"a":"b"}').otherwise(F.col("props"))
    return events.select(
        "event_id", V.is_count_map(text).alias("valid"), F.try_element_at(V.count_map(text), F.lit("k")).alias("k")
    )


@query(
    "delimiters_and_members",
    with_tables(
        "manifest",
        """select st_oid, coalesce(left(delimiter, 1), ',') as delimiter, collect_type in ('Download', 'REST') as fetchable,
                  contains(lower(url), '/arcgis/rest/') as is_service from manifest""",
    ),
)
def delimiters_and_members(spark, sf):
    return derived(spark, sf, "manifest").select(
        "st_oid",
        N.delimiter_char(F.col("delimiter")).alias("delimiter"),
        V.member_of(F.col("collect_type"), ["Download", "REST"]).alias("fetchable"),
        N.contains_ignore_case(F.col("url"), "/ArcGIS/rest/").alias("is_service"),
    )


@query(
    "iso_times",
    """select event_id, strftime(ts, '%Y-%m-%d') as day,
              coalesce(regexp_replace(strftime(if(event_id % 2 = 0, null, ts), '%Y-%m-%dT%H:%M:%S.%f'), '\\.?0+$', ''), '') as stamp from events""",
)
def iso_times(spark, sf):
    events = sql(spark, sf, "select event_id, ts, if(event_id % 2 = 0, null, ts) as maybe from {events}")
    return events.select("event_id", V.iso_date(F.col("ts")).alias("day"), V.iso_datetime(F.col("maybe")).alias("stamp"))


@query(
    "csv_records",
    """select doc_id, '"' || doc_id || '","' || replace(text, '"', '""') || '","' || replace(source || '"q"', '"', '""') || '",""' as record
       from documents""",
)
def csv_records(spark, sf):
    documents = given(spark, sf, "documents")
    source = F.concat("source", F.lit('"q"'))
    return documents.select(
        "doc_id", V.csv_record([F.col("doc_id").cast("string"), F.col("text"), source, F.lit(None).cast("string")]).alias("record")
    )


@query(
    "merged_maps",
    """select event_id, if(event_id % 2 = 0, event_type, json_extract_string(props, '$.k')) as k,
              cast(user_id as varchar) as u from events""",
)
def merged_maps(spark, sf):
    events = given(spark, sf, "events")
    left = F.create_map(F.lit("k"), F.get_json_object("props", "$.k"), F.lit("u"), F.col("user_id").cast("string"))
    right = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("k"), F.col("event_type")))
    merged = merged_map(left, right)
    return events.select("event_id", merged["k"].alias("k"), merged["u"].alias("u"))
