"""SQL for DuckDB that must give the rows of the queries in `registry`."""

from __future__ import annotations

from filescape.functions.labels import NATIVE_MIME_LABELS, TYPE_LABELS
from filescape.plans import registry as r
from filescape.plans.views import (
    DOC_FILES,
    DRIVE_MANIFEST,
    LAKE_FILES,
    PAGE_FILES,
    PART_FILES,
    sql_view,
)

EXT = r"lower(regexp_extract(name, '^.+(\.[^./]*)$', 1))"
STEM = f"case when ends_with(name, {EXT}) then left(name, length(name) - length({EXT})) else name end"
SHAPE = "regexp_replace(regexp_replace({}, '[A-Za-z]+', 'A', 'g'), '[0-9]+', 'D', 'g')"
SEGMENTS = "regexp_extract_all({}, '[A-Za-z]+|[0-9]+|[^A-Za-z0-9]+')"
TOKENS = "regexp_extract_all(lower(name), '[a-z0-9]+')"
NOISE = "('.git', 'node_modules', 'vendor', '.DS_Store', '__pycache__', '.idea', '.vscode')"
HIDDEN = f"lambda x: x like '.%' or x in {NOISE}"
SHOWN = "case when ext = '' then '(no extension)' else ext end"
FLAT = "replace(case when starts_with({0}, '/') then substr({0}, 2) else {0} end, '/', '__')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _values(table: dict[str, str]) -> str:
    rows = ", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in table.items())
    return f"(values {rows})"


LABELS = f"{_values(TYPE_LABELS)} l(label_ext, label)"
NATIVE = f"{_values(NATIVE_MIME_LABELS)} m(mime, native_label)"
LABEL = (
    "coalesce(label, case when ext = '' then 'File (no extension)' else substr(ext, 2) || ' file' end)"
)

# All documents, as they are and with their keys, extensions and labels.
DOCS = f"""
docs as materialized (select * from {sql_view(DOC_FILES)} v),
files as materialized (
  select d.*, {LABEL} as type_label from (
    select path, name, size, lang, content, {EXT} as ext, sha256(content) as dedup_key from docs) d
  left join {LABELS} on label_ext = d.ext)
"""
# The same for the documents in scope.
SHOWN_DOCS = DOCS.replace("from docs)", f"""from docs
    where not name like '.%'
      and len(list_filter(string_split(path, '/')[3:-2], {HIDDEN})) = 0)""")
GROUPS = """
groups as materialized (
  select dedup_key, copies, first_path, size, (copies - 1) * size as wasted,
    'D' || row_number() over (order by first_path) as label
  from (select dedup_key, count(*) as copies, min(path) as first_path, arg_min(size, path) as size
        from files group by dedup_key) where copies >= 2)
"""
# Directories holding files, hidden files too.
ALL_DIRS = """
all_dirs as materialized (
  select distinct list_aggregate(parts[1:n], 'string_agg', '/') as path
  from (select parts, unnest(range(3, len(parts))) as n
        from (select string_split(path, '/') as parts from docs)))
"""
DIRS = f"""
{ALL_DIRS},
dirs as materialized (
  select path, string_split(path, '/')[-1] as name from all_dirs
  where len(list_filter(string_split(path, '/')[3:], {HIDDEN})) = 0)
"""
EVERY_DIR = f"""
{ALL_DIRS},
dirs as materialized (select path, string_split(path, '/')[-1] as name from all_dirs)
"""
# Every directory with the bytes below it.
SIZED = """
sized as materialized (
  select d.path, cast(coalesce(sum(f.size), 0) as bigint) as size
  from (select path from dirs union all select '/corpus') d
  left join files f on starts_with(f.path, d.path || '/') group by d.path)
"""
LAKE = f"lake as materialized (select * from {sql_view(LAKE_FILES)} v)"
PARTS = f"parts as materialized (select * from {sql_view(PART_FILES)} v)"
PAGES = f"page_files as materialized (select * from {sql_view(PAGE_FILES)} v)"
MANIFEST = f"manifest as materialized (select * from {sql_view(DRIVE_MANIFEST)} v)"
NODES = """
nodes as materialized (
  with recursive walk as (
    select id, parent_id, name, mime_type, size, md5, modified_time, 'My Drive/' || name as path, ['root'] as ancestors
    from manifest where parent_id = 'root' and not trashed
    union all
    select c.id, c.parent_id, c.name, c.mime_type, c.size, c.md5, c.modified_time, w.path || '/' || c.name,
      list_append(w.ancestors, w.id)
    from manifest c join walk w on c.parent_id = w.id
    where not c.trashed and w.mime_type = 'application/vnd.google-apps.folder')
  select *, mime_type = 'application/vnd.google-apps.folder' as is_dir from walk)
"""
LINES = r"""
lines as materialized (
  select path, lang, cast(k as bigint) as line, raw[k] as raw from (
    select path, lang, raw, unnest(range(1, len(raw) + 1)) as k from (
      select path, lang, case when content = '' then []
        when ends_with(content, chr(10)) then string_split(left(content, length(content) - 1), chr(10))
        else string_split(content, chr(10)) end as raw from files)))
"""
TEXT = "case when ends_with(raw, chr(13)) then left(raw, length(raw) - 1) else raw end"


def _with(*ctes: str) -> str:
    return "with " + ", ".join(cte.strip() for cte in ctes) + " "


def _refined(source: str, least: int, rounds: int = 6) -> str:
    """The splitting rounds of template mining, unrolled."""
    steps = [
        f"""
n0 as materialized (
  select path, name, ext, ext || '|' || {SHAPE.format('stem')} as g, {SEGMENTS.format('stem')} as segs
  from (select path, name, {EXT} as ext, {STEM} as stem from {source}))"""
    ]
    for k in range(rounds):
        steps.append(
            f"""
p{k} as materialized (
  select g, pos, count(*) as nv, min(c) as rarest, cast(sum(c) as bigint) as total from (
    select g, pos, value, count(*) as c from (
      select g, pos, segs[pos + 1] as value from (select g, segs, unnest(range(len(segs))) as pos from n{k}))
    where regexp_matches(value, '^[A-Za-z0-9]') group by g, pos, value)
  group by g, pos),
d{k} as materialized (
  select g, max(total) as total, min(pos) filter (nv >= 2 and rarest >= {least}) as split,
    list(pos order by pos) filter (nv >= 2) as varying
  from p{k} group by g),
n{k + 1} as materialized (
  select n.path, n.name, n.ext, n.segs,
    case when split is null then n.g else n.g || '|' || split || '=' || segs[split + 1] end as g
  from n{k} n left join d{k} d on n.g = d.g)"""
        )
    last = rounds - 1
    steps.append(
        f"""
refined as materialized (
  select n.path, n.g as group_key, d.total as count,
    list_aggregate(list_transform(range(len(segs)), lambda i: case when list_contains(varying, i)
      then '{{' || list_position(varying, i) || '}}' else segs[i + 1] end), 'string_agg', '') || ext as template,
    list_aggregate(list_transform(varying, lambda i: segs[i + 1]), 'string_agg', ',') as fields
  from n{rounds} n join d{last} d on n.g = d.g
  where d.total >= {least} and len(d.varying) > 0)"""
    )
    return ", ".join(step.strip() for step in steps)


def _bucket_positions(source: str, least: int) -> str:
    return f"""
positions as materialized (
  select ext, shape, pos, count(*) as n_values, min(c) as rarest, sum(c) as total from (
    select ext, shape, pos, value, count(*) as c from (
      select ext, shape, pos, segs[pos + 1] as value from (
        select ext, shape, segs, unnest(range(len(segs))) as pos from (
          select ext, {SHAPE.format('stem')} as shape, {SEGMENTS.format('stem')} as segs
          from (select {EXT} as ext, {STEM} as stem from {source}))))
    where regexp_matches(value, '^[A-Za-z0-9]') group by all)
  group by ext, shape, pos having sum(c) >= {least} and count(*) >= 2)"""


def _human(size: str) -> str:
    whens = " ".join(
        f"when {size} >= {1024**p} then printf('%.1f {u}iB', cast({size} as double) / cast({1024**p} as double))"
        for p, u in reversed(list(enumerate("KMGTPE", start=1)))
    )
    return f"case {whens} else cast({size} as varchar) || ' B' end"


def _find(where: str) -> str:
    return f"select path, size, ext, type_label from files where {where}"


FOUND = _find("ext in ('.md', '.html') and contains(lower(name), 'en_') and size >= 300 and size <= 20480")
MATCH = f"regexp_matches({TEXT}, {_quoted('(?i)' + r.GREP_PATTERN)})"
FIXED = f"select path, line, {TEXT} as text from lines where contains({TEXT}, {_quoted(r.FIXED_TEXT)})"
_PART_TERMS = "list_contains({0}, 'ring') and list_contains({0}, 'small') and list_contains({0}, 'dat')"

DECIDED = """
answers as (
  select distinct dedup_key, left(dedup_key, 1) as digit from files),
numbered as (
  select f.dedup_key, f.path, f.size, g.copies, a.digit,
    row_number() over (partition by f.dedup_key order by f.path) as n
  from files f join groups g using (dedup_key) join answers a using (dedup_key)),
plan as materialized (
  select dedup_key, path, size, case when digit in ('3', '4', '5') then 'skip'
    when n = case when digit in ('0', '1', '2', '8') then 2 else 1 end then 'keep' else 'trash' end as action
  from numbered)
"""
_ORDER_TEXT = """
select o_orderkey, o_orderdate, o_orderpriority as p, case
  when p = '1-URGENT' then strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S+02:30')
  when p = '2-HIGH' then strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.250Z')
  when p = '3-MEDIUM' then strftime(o_orderdate, '%Y-%m-%d')
  when p = '5-LOW' then strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')
  else strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') end as text from orders
"""
_SIZE_TEXT = """
select p_partkey, concat(case when p_type = 'ECONOMY' then ' ' else '' end, cast(p_size as varchar),
  case when p_type = 'SMALL' then '.5' else '' end,
  ['', 'KB', ' MiB', 'g', 'PiB', '.1.2', ' k ', 'TB', 'x'][p_size % 9 + 1]) as text from part
"""

ORACLE: dict[str, str] = {
    # Sources
    "file_catalog": _with(SHOWN_DOCS, DIRS)
    + """
select substr(path, 8) as path, substr(path, 8, length(path) - length(name) - 8) as parent, name,
  is_dir, false as is_symlink, size
from (select path, name, false as is_dir, size from files
      union all select path, name, true, cast(0 as bigint) from dirs)""",
    "manifest_source": _with(MANIFEST)
    + "select id, name, parent_id, mime_type, size, md5 from manifest where not trashed",
    "file_content": _with(DOCS)
    + f"""
select substr(path, 8) as path, size as bytes, greatest(1, (size + {r.CHUNK_BYTES - 1}) // {r.CHUNK_BYTES})::bigint as chunks,
  dedup_key as hash from files""",
    "filetree": _with(SHOWN_DOCS)
    + f"""
select substr(path, 8) as path, name, ext, false as is_symlink, size from files
where ext in ('.txt', '.html') and size >= {r.LARGE_BYTES}""",
    "live_hashes": _with(DOCS)
    + f"""
select path, size, case when count(*) over (partition by size, edges) >= 2 then dedup_key end as dedup_key
from (select substr(path, 8) as path, size, dedup_key, case when size <= {2 * r.EDGE_BYTES} then dedup_key
    else sha256(encode(content)[1:{r.EDGE_BYTES}] || encode(content)[size - {r.EDGE_BYTES - 1}:size]) end as edges from files)""",
    "live_grep": _with(DOCS, LINES)
    + f"select substr(path, 8) as path, line, {TEXT} as text from lines where {MATCH}",
    "live_lines": _with(DOCS, LINES)
    + f"""
select substr(path, 8) as path, line, {TEXT} as text from lines left join (
  select path, min(line) as bad from lines where strlen(raw) >= {r.LINE_CAP} group by path) using (path)
where bad is null or line < bad""",
    # Sinks
    "find_json": _with(DOCS)
    + f"""
select ext, count, size, block, string_agg(path, chr(10) order by path) as paths,
  string_agg(cast(fsize as varchar), chr(10) order by path) as sizes,
  string_agg(type_label, chr(10) order by path) as labels
from (select {SHOWN} as ext, path, size as fsize, type_label, count(*) over w as count,
        cast(sum(size) over w as bigint) as size,
        cast(floor((row_number() over (partition by ext order by path) - 1) / {r.PER_DOCUMENT}) as bigint) as block
      from files window w as (partition by ext))
group by ext, count, size, block""",
    "search_json": _with(PARTS)
    + f"select path from parts where {_PART_TERMS.format(TOKENS)}",
    "grep_json": _with(DOCS, LINES) + FIXED,
    "grep_text": _with(DOCS, LINES)
    + f"select concat(path, ':', line, ':', text) as value from ({FIXED})",
    "patterns_json": _with(DOCS, _refined("files", 2))
    + f"""
select template, count, block, string_agg(path, chr(10) order by path) as paths,
  string_agg(fields, chr(10) order by path) as fields
from (select *, cast(floor((row_number() over (partition by group_key order by path) - 1)
        / {r.PER_DOCUMENT}) as bigint) as block from refined)
group by group_key, template, count, block""",
    "index_json": _with(LAKE)
    + f"""
select token, block, string_agg(path, chr(10) order by path) as paths
from (select token, path, cast(floor((row_number() over (partition by token order by path) - 1)
        / {r.POSTINGS_BLOCK}) as bigint) as block
      from (select distinct path, unnest({TOKENS}) as token from lake))
group by token, block""",
    "index_json_stats": _with(LAKE)
    + f"""
select (select count(*) from lake) as files, count(distinct token) as tokens, count(*) as postings
from (select distinct path, unnest({TOKENS}) as token from lake)""",
    "tree_json": _with(DOCS, GROUPS, EVERY_DIR, SIZED)
    + """
select f.path, left(f.path, length(f.path) - length(f.name) - 1) as parent, f.name, false as is_dir, f.size, f.ext,
  f.type_label, f.dedup_key, coalesce(label, '') as dup_label, 1600000000 + doc_id as mtime
from files f join docs using (path) left join groups g on f.dedup_key = g.dedup_key
union all
select path, case when path = '/corpus' then '/' else left(path, length(path) - length(name) - 1) end,
  name, true, size, '', '', null, null, null
from (select *, string_split(path, '/')[-1] as name from sized)""",
    "tree_json_stats": _with(DOCS, GROUPS, EVERY_DIR)
    + """
select (select count(*) from groups) as dup_groups, (select cast(sum(wasted) as bigint) from groups) as wasted_size,
  count(*) as files, (select count(*) from dirs) as dirs, cast(sum(size) as bigint) as size from files""",
    "manifest_times": _with(MANIFEST, NODES)
    + """
select id, coalesce(case when regexp_full_match(modified_time, '[0-9]{4}-.*T.*') then epoch_us(try_cast(modified_time as timestamptz)) end, -1) as micros
from nodes""",
    "write_output": _with(DOCS)
    + f"select {SHOWN} as ext, count(*) as count, cast(sum(size) as bigint) as size from files group by 1",
    # Filters
    "visible_files": _with(SHOWN_DOCS) + "select path, name, size from files",
    "drop_symlinks": _with(DOCS) + "select path, size from docs where lang <> 'fr'",
    "ext_filter": _with(DOCS) + "select path, ext from files where ext in ('.txt', '.html')",
    "ext_list_parse": _with(DOCS) + "select path, ext from files where ext in ('.html', '.log')",
    "name_contains": _with(DOCS)
    + "select path, name from files where contains(lower(name), 'src1')",
    "size_range": _with(LAKE)
    + "select path, size from lake where size >= 500000 and size <= 5000000",
    "find_files": _with(DOCS) + FOUND,
    "grep_too_large": _with(DOCS)
    + f"select path, size from files where size > {r.LARGE_BYTES}",
    "text_only": _with(DOCS)
    + """
select path from (select path, case lang when 'fr' then 'a' || chr(0) || content
    when 'de' then content || chr(10) || chr(0) else content end as marked from files)
where not contains(split_part(marked, chr(10), 1), chr(0))""",
    "resolve_folder": _with(MANIFEST)
    + f"""
select id, name from manifest where name = '{r.FOLDER_NAME}' and not trashed
  and mime_type = 'application/vnd.google-apps.folder'""",
    # Derived columns
    "file_ext": _with(DOCS) + f"select path, {EXT} as ext from docs",
    "type_label": _with(DOCS)
    + f"""
select path, ext, {LABEL} as type_label from (select path, {EXT} as ext from docs)
left join {LABELS} on label_ext = ext""",
    "drive_type_label": _with(MANIFEST)
    + f"""
select id, case when native_label is null then ext else '' end as ext,
  coalesce(native_label, {LABEL}) as type_label
from (select id, mime_type, {EXT} as ext from manifest)
left join {LABELS} on label_ext = ext left join {NATIVE} on mime = mime_type""",
    "content_hash": _with(PAGES) + "select path, sha256(content) as hash from page_files",
    "drive_dedup_key": _with(MANIFEST)
    + """
select id, case when md5 is not null and md5 <> '' then 'md5:' || md5
  else concat('namesize:', name, ':', size) end as dedup_key from manifest""",
    "modified_time": f"""
select o_orderkey, text, case when p = '1-URGENT' then epoch_us(o_orderdate) - 9000000000
  when p = '2-HIGH' then epoch_us(o_orderdate) + 250000 when p in ('3-MEDIUM', '5-LOW') then -1
  else epoch_us(o_orderdate) end as micros from ({_ORDER_TEXT})""",
    "human_size": _with(LAKE)
    + f"""
select path, {_human('size')} as plain, {_human('(size // 100000)')} as small,
  {_human('(size * 4096)')} as large, {_human('(size * 100000000)')} as huge from lake""",
    "parse_size": f"""
select p_partkey, text, coalesce(cast(floor(n * case u when '' then 1 when 'KB' then 1e3 when 'MIB' then 1048576
    when 'G' then 1073741824 when 'K' then 1024 when 'TB' then 1e12 end) as bigint), -1) as bytes
from (select *, try_cast(regexp_extract(trim(text), '^[0-9.]+') as double) as n,
        upper(trim(regexp_replace(trim(text), '^[0-9.]+', ''))) as u from ({_SIZE_TEXT}))""",
    "name_tokens": _with(DOCS)
    + f"select path, list_aggregate({TOKENS}, 'string_agg', ' ') as tokens from docs",
    "name_segments": _with(DOCS)
    + f"""
select path, list_aggregate(list_transform({SEGMENTS.format(STEM)}, lambda s:
  case when regexp_matches(s, '^[A-Za-z]') then 'A:' when regexp_matches(s, '^[0-9]') then 'D:' else 'S:' end || s),
  'string_agg', '|') as segments from docs""",
    "name_stem": _with(DOCS) + f"select path, {STEM} as stem from docs",
    "shape_key": _with(DOCS) + f"select path, {SHAPE.format(STEM)} as shape from docs",
    "trash_name": _with(LAKE) + f"select path, {FLAT.format('path')} as target from lake",
    "full_path": _with(MANIFEST, NODES) + "select id, path, is_dir from nodes",
    "tree_order": _with(DOCS, ALL_DIRS)
    + """
select path, row_number() over (order by list_transform(string_split(substr(path, 9), '/'),
  lambda x: {'a': lower(x), 'b': x})) as position
from (select path from docs union all select path from all_dirs)""",
    # Joins
    "tag_duplicates": _with(DOCS, GROUPS)
    + "select path, f.size, coalesce(label, '') as dup_label from files f left join groups g using (dedup_key)",
    "search_many": _with(PARTS)
    + f"""
select q as query_id, path from (select distinct p_name as q from part),
  (select path, {TOKENS} as tokens from parts)
where len(list_filter(regexp_extract_all(lower(q), '[a-z0-9]+'), lambda t: not list_contains(tokens, t))) = 0""",
    # Aggregations
    "dir_sizes": _with(LAKE)
    + """
select list_aggregate(parts[1:n], 'string_agg', '/') as path, cast(sum(size) as bigint) as size,
  count(*) as files
from (select parts, size, unnest(range(2, len(parts))) as n
      from (select string_split(path, '/') as parts, size from lake)) group by 1""",
    "scan_summary": _with(SHOWN_DOCS, GROUPS, DIRS)
    + """
select (select count(*) from files) as total_files, (select count(*) from dirs) as total_dirs,
  (select cast(sum(size) as bigint) from files) as total_size,
  (select count(*) from groups) as dup_groups,
  (select cast(sum(wasted) as bigint) from groups) as wasted_size""",
    "ext_stats": _with(DOCS)
    + f"select {SHOWN} as ext, count(*) as count, cast(sum(size) as bigint) as size from files group by 1",
    "duplicate_groups": _with(DOCS, GROUPS)
    + "select label, dedup_key, copies, first_path, size, wasted from groups",
    "duplicate_members": _with(DOCS, GROUPS)
    + """
select label as dup_label, row_number() over (partition by dedup_key order by path) as copy, path, f.size
from files f join groups g using (dedup_key)""",
    "wasted_size": _with(DOCS, GROUPS)
    + "select count(*) as dup_groups, cast(sum(wasted) as bigint) as wasted_size from groups",
    "group_by_ext": _with(DOCS)
    + f"""
select {SHOWN} as ext, path, size, type_label, count(*) over w as ext_count,
  cast(sum(size) over w as bigint) as ext_size from files window w as (partition by ext)""",
    "find_totals": _with(DOCS)
    + f"select count(*) as count, cast(coalesce(sum(size), 0) as bigint) as size from ({FOUND})",
    "index_stats": _with(LAKE)
    + f"""
select (select count(*) from lake) as files,
  (select count(distinct token) from (select unnest({TOKENS}) as token from lake)) as tokens""",
    "grep_counts": _with(DOCS, LINES)
    + f"""
select (select count(*) from lines join files using (path) where size <= {r.LARGE_BYTES} and {MATCH}) as matches,
  (select count(*) from files where size > {r.LARGE_BYTES}) as skipped""",
    "drive_duplicates": _with(MANIFEST, NODES)
    + """
select 'D' || row_number() over (order by first_path, first_id) as label, dedup_key, copies, first_path,
  size, (copies - 1) * size as wasted, first_id, string_split(dedup_key, ':')[1] as key_kind
from (select dedup_key, count(*) as copies, min({'p': path, 'i': id, 's': size}).p as first_path,
        min({'p': path, 'i': id, 's': size}).i as first_id, min({'p': path, 'i': id, 's': size}).s as size
      from (select *, case when md5 is not null then 'md5:' || md5
              else concat('namesize:', name, ':', size) end as dedup_key
            from nodes where not is_dir) group by dedup_key) where copies >= 2""",
    "folder_sizes": _with(MANIFEST, NODES)
    + """
select id, cast(sum(size) as bigint) as size, cast(sum(files) as bigint) as files from (
  select unnest(ancestors) as id, size, 1 as files from nodes where not is_dir
  union all select id, 0, 0 from nodes where is_dir) group by id""",
    # Order
    "largest_files": _with(LAKE)
    + "select path, size from lake order by size desc, path limit 10",
    "sorted_paths": _with(LAKE)
    + "select path, row_number() over (order by path) as position from lake",
    "tree_listing": _with(SHOWN_DOCS, GROUPS, DIRS, SIZED)
    + f"""
select path, cast(len(string_split(path, '/')) - 2 as bigint) as depth,
  row_number() over (partition by list_aggregate(string_split(path, '/')[:-2], 'string_agg', '/')
    order by lower(name) desc, name desc) = 1 as is_last,
  shown, type_label, {_human('size')} as human_size, dup_label
from (select f.path, f.name, f.name as shown, f.type_label, f.size, coalesce(label, '') as dup_label
      from files f left join groups g using (dedup_key)
      union all
      select path, string_split(path, '/')[-1], string_split(path, '/')[-1] || '/', '', size, '' from sized)""",
    # Index and search
    "postings_intersect": _with(LAKE)
    + f"""
select path from (select path, {TOKENS} as tokens from lake)
where list_contains(tokens, 'part') and list_contains(tokens, '3') and list_contains(tokens, 'parquet')""",
    "name_index": _with(LAKE)
    + f"select token, path from (select distinct path, unnest({TOKENS}) as token from lake)",
    "name_search": _with(PARTS)
    + f"select path, name from parts where {_PART_TERMS.format(TOKENS)}",
    # Content
    "grep_pattern": _with(PAGES, LINES.replace("from files", "from page_lang"), )
    .replace("lines as", "page_lang as (select *, '' as lang from page_files), lines as", 1)
    + f"select path, line, {TEXT} as text from lines where regexp_matches({TEXT}, {_quoted(r.PAGE_PATTERN)})",
    "split_lines": _with(DOCS, LINES) + f"select path, line, {TEXT} as text from lines",
    "line_cap": _with(DOCS, LINES)
    + f"""
select path, line, {TEXT} as text from lines left join (
  select path, min(line) as bad from lines where strlen(raw) >= {r.LINE_CAP} group by path) using (path)
where bad is null or line < bad""",
    "grep_files": _with(DOCS, LINES)
    + f"""
select path, line, {TEXT} as text from lines
where {MATCH}""",
    # Naming templates
    "pattern_buckets": _with(DOCS)
    + f"""
select ext, {SHAPE.format('stem')} as shape, count(*) as count
from (select ext, {STEM} as stem from files) group by 1, 2 having count(*) >= 2""",
    "varying_positions": _with(PARTS, _bucket_positions("parts", 2))
    + "select ext, shape, pos, n_values from positions",
    "split_position": _with(DOCS, _bucket_positions("files", 2))
    + "select ext, shape, min(pos) as pos from positions where rarest >= 2 group by ext, shape",
    "refine_patterns": _with(PARTS, _refined("parts", 2))
    + "select distinct group_key, template, count from refined",
    "name_patterns": _with(LAKE, _refined("lake", 2))
    + "select template, count, path, fields from refined",
    "name_patterns_docs": _with(DOCS, _refined("files", 3))
    + "select template, count, path, fields from refined",
    # Clean-up
    "dedup_keep_first": _with(DOCS, GROUPS)
    + """
select dedup_key, path, case when path = first_path then 'keep' else 'trash' end as action
from files join groups using (dedup_key)""",
    "cleanup_plan": _with(DOCS, GROUPS, DECIDED)
    + f"""
select dedup_key, path, size, action,
  case when action = 'trash' then {FLAT.format('path')} end as target from plan""",
    "cleanup_summary": _with(DOCS, GROUPS, DECIDED)
    + """
select count(*) filter (action = 'keep') as groups_handled, count(*) filter (action = 'trash') as files_moved,
  cast(coalesce(sum(size) filter (action = 'trash'), 0) as bigint) as bytes_freed from plan""",
    "trash_collisions": _with(DOCS)
    + f"""
select target, count(*) as files, min(path) as first_path, max(path) as last_path
from (select path, {FLAT.format('path')} as target,
        row_number() over (partition by dedup_key order by path) as n
      from (select path, dedup_key from files
            union all select '/corpus__' || replace(substr(path, 9), '/', '__'), dedup_key from files))
where n > 1 group by target having count(*) > 1""",
    "unique_files": _with(DOCS)
    + "select dedup_key, min(path) as path, arg_min(size, path) as size from files group by dedup_key",
}

# The same questions through other access paths.
ORACLE["stored_search"] = ORACLE["postings_intersect"]
ORACLE["stored_search_many"] = ORACLE["search_many"]
ORACLE["grep_indexed"] = ORACLE["grep_pattern"]
ORACLE["live_grep_indexed"] = (
    _with(DOCS, LINES)
    + f"select substr(path, 8) as path, line, {TEXT} as text from lines where contains({TEXT}, {_quoted(r.FIXED_TEXT)})"
)
ORACLE["token_sketch"] = (
    _with(LAKE, PARTS)
    + f"""
select count(*) as files, (select count(distinct token) from (
    select unnest({TOKENS}) as token from (select name, path from lake union all select name, path from parts))) as tokens,
  true as within
from (select path from lake union all select path from parts)"""
)
