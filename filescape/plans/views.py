"""File listings derived from the provided tables.

The same select statements serve Spark and the SQL check; `{S}` is the string type and
`{BYTES}` the byte length function of the engine, the table names are filled in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DOC_ROOT = "/corpus"
LAKE_ROOT = "/lake"
PAGE_ROOT = "/web"
PART_ROOT = "/parts"

DOC_FILES = """
select doc_id,
  concat('/corpus/', source, '/b', cast(doc_id - doc_id % 40 as {S}), '/',
    case when doc_id % 25 = 0 then 'node_modules/' when doc_id % 25 = 1 then '.git/'
         when doc_id % 25 = 2 then concat(lang, '/deep/') else concat(lang, '/') end, nm) as path,
  nm as name, cast({BYTES}(text) as bigint) as size, lang, text as content
from (select *, concat(case when doc_id % 31 = 0 then '.' else '' end, lang, '_', source, '_',
    cast(doc_id % 40 as {S}),
    case when doc_id % 6 = 0 then '.txt' when doc_id % 6 = 1 then '.md' when doc_id % 6 = 2 then '.HTML'
         when doc_id % 6 = 3 then '.log' when doc_id % 6 = 4 then '' else '.xyz' end) as nm
  from {documents}) d
"""

LAKE_FILES = """
select concat('/lake/', l_returnflag, '/', l_linestatus, '/p', cast(l_partkey as {S}), '/s',
    cast(l_suppkey as {S}), '/', nm) as path,
  nm as name, cast(round(l_extendedprice * 100) as bigint) as size
from (select *, concat('part_', cast(l_linenumber as {S}), '_', cast(l_orderkey as {S}), '.parquet') as nm
  from {lineitem}) d
"""

DRIVE_MANIFEST = """
select concat('R', cast(r_regionkey as {S})) as id, r_name as name, 'root' as parent_id,
  'application/vnd.google-apps.folder' as mime_type, cast(0 as bigint) as size,
  cast(null as {S}) as md5, false as trashed, cast(null as {S}) as modified_time from {region}
union all select concat('N', cast(n_nationkey as {S})), n_name, concat('R', cast(n_regionkey as {S})),
  'application/vnd.google-apps.folder', cast(0 as bigint), cast(null as {S}), false, cast(null as {S}) from {nation}
union all select concat('C', cast(c_custkey as {S})), c_name, concat('N', cast(c_nationkey as {S})),
  'application/vnd.google-apps.folder', cast(0 as bigint), cast(null as {S}), c_custkey % 50 = 0,
  case when c_custkey % 3 = 0 then '2024-02-30T00:00:00Z' when c_custkey % 3 = 1 then '2024-02-29T23:59:59.5+01:00' else 'yesterday' end from {customer}
union all select concat('O', cast(o_orderkey as {S})),
  concat('order_', cast(o_orderkey % 100 as {S}), case when o_orderkey % 4 = 0 then '' else '.pdf' end),
  concat('C', cast(o_custkey as {S})),
  case when o_orderkey % 4 = 0 then 'application/vnd.google-apps.document' else 'application/pdf' end,
  case when o_orderkey % 4 = 0 then cast(0 as bigint) else cast(round(o_totalprice * 100) as bigint) end,
  case when o_orderkey % 4 = 0 then cast(null as {S}) else md5(cast(o_orderkey % 500 as {S})) end,
  o_orderkey % 97 = 0, concat(substr(cast(o_orderdate as {S}), 1, 10), 'T12:00:00Z') from {orders}
"""

PAGE_FILES = """
select concat('/web/p', cast(page_id as {S}), '/', nm) as path, nm as name,
  cast({BYTES}(html) as bigint) as size, html as content
from (select *, coalesce(nullif(regexp_extract(url, '/([^/?#]*)([?#].*)?$', 1), ''), 'index.html') as nm
  from {pages}) d
"""

PART_FILES = """
select concat('/parts/', p_brand, '/', cast(p_partkey as {S}), '/', nm) as path, nm as name,
  cast(round(p_retailprice * 100) as bigint) as size
from (select *, concat(replace(p_name, ' ', '_'), '_', cast(p_size as {S}), '.dat') as nm from {part}) d
"""

_TABLES = {
    DOC_FILES: ("documents",),
    LAKE_FILES: ("lineitem",),
    DRIVE_MANIFEST: ("region", "nation", "customer", "orders"),
    PAGE_FILES: ("pages",),
    PART_FILES: ("part",),
}

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spark_view(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    """A view as a Spark DataFrame."""
    names = _TABLES[view]
    # The table names stay as they are for spark.sql, which binds them to the frames.
    text = view.format(S="string", BYTES="octet_length", **{n: "{" + n + "}" for n in names})
    return spark.sql(text, **{n: table(spark, sf_dir, n) for n in names})


def sql_view(view: str) -> str:
    """A view as a parenthesised select for the SQL check."""
    names = _TABLES[view]
    return "(" + view.format(S="varchar", BYTES="strlen", **{n: n for n in names}).strip() + ")"


def doc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark_view(spark, sf_dir, DOC_FILES)


def lake_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark_view(spark, sf_dir, LAKE_FILES)


def drive_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark_view(spark, sf_dir, DRIVE_MANIFEST)


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark_view(spark, sf_dir, PAGE_FILES)


def part_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark_view(spark, sf_dir, PART_FILES)
