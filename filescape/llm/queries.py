"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filescape.llm import chat, codebooks, jaccard, language, mixing, packing, pivots, quality, repeats, runs, seating, wand, warc
from filescape.llm.tables import table
from filescape.session import cut, shared_path

PROBE = "</s>[INST] ok [/INST]"


def tokenizer() -> str:
    """Place of the tokenizer file; other queries do without its package."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), path, cut)
    records = warc.read_records(warc.read_chunks(spark, path))
    return records.select(
        F.col("page").cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


def op2_word_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    field = language.fit_field(documents, language.remainder("doc_id", 5) != 0)
    found = language.identify(documents, field)
    return found.select("doc_id", (language.remainder("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def op3_reply_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PROBE).alias("text"),
    )
    return chat.round_trip(chat.expand_replies(turns.unionByName(probe)))


def op4_lyndon_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.without_repeats(table(spark, sf_dir, "documents"), cut)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op5_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer(), cut)


def op6_source_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed, _, _ = mixing.mix_sources(table(spark, sf_dir, "documents"), cut)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "first_slot")


def op7_pivot_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_vectors(table(spark, sf_dir, "embeddings"), cut)


def op8_word_seating(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return seating.score_documents(documents, language.remainder("doc_id", 7) == 2, cut)


def op9_block_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return wand.search(documents, documents.filter("doc_id % 100 = 0"), cut)


def op10_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_documents(table(spark, sf_dir, "documents"), cut)


def op11_lyndon_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    planted = runs.plant_periods(documents, language.remainder("doc_id", 1 << 32))
    return runs.run_facts(runs.find_runs(planted))


def op12_hilbert_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = codebooks.encode_vectors(table(spark, sf_dir, "embeddings"), cut)
    return coded.select("vec_id", "code", "error", "label_error", F.lit(codebooks.books_digest(books)).alias("codebooks_sha256"))


def op13_trusted_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.score_quality(documents, labels, language.remainder("doc_id", 5) == 0, cut)


QUERIES = {
    "op1_warc_chunks": op1_warc_chunks,
    "op2_word_field": op2_word_field,
    "op3_reply_examples": op3_reply_examples,
    "op4_lyndon_groups": op4_lyndon_groups,
    "op5_curve_packing": op5_curve_packing,
    "op6_source_schedule": op6_source_schedule,
    "op7_pivot_lists": op7_pivot_lists,
    "op8_word_seating": op8_word_seating,
    "op9_block_max": op9_block_max,
    "op10_prefix_join": op10_prefix_join,
    "op11_lyndon_runs": op11_lyndon_runs,
    "op12_hilbert_blocks": op12_hilbert_blocks,
    "op13_trusted_positives": op13_trusted_positives,
}

_B32 = " || ".join(
    f"lpad(to_base(('0x' || substr(d, {at}, 5))::bigint, 32), 4, '0')" for at in range(1, 41, 5)
)
_ESCAPED = "regexp_replace(replace(coalesce({0}, ''), '\\', '\\\\'), '([<\\[])(/?(?:s>|INST\\]))', '\\1\\\\\\2', 'g')"

# CRC-32 of the decimal id, byte by byte through the table of its polynomial
_CRC_TABLE = """list_transform(range(256), lambda i: list_reduce(range(8),
    lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i))"""
_CRC = """xor(list_reduce(list_transform(range(1, length(coalesce(doc_id::varchar, '')) + 1), lambda i: ord(substr(doc_id::varchar, i, 1))::bigint),
    lambda c, b: xor(c >> 8, steps[xor(c & 255, b) + 1]), 4294967295), 4294967295)"""

# one assignment of all parts to the entries of a round, and the four rounds
_NEAREST = """select p.part, p.r, any_value(p.x) as x, arg_min(e, d * 256 + e) as e, min(d) as d
  from (select p.part, p.r, p.x, c.e, list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d
    from p join c{0} c on p.part = c.part) p group by p.part, p.r"""
_LLOYD = "\n".join(f"""a{i} as materialized ({_NEAREST.format(i)}),
m{i} as (select part, e, place, floor(sum(x)::double / count(*))::bigint as m
  from (select part, e, unnest(range(len(x))) as place, unnest(x) as x from a{i}) group by part, e, place),
n{i} as materialized (select part, e, list(m order by place) as x from m{i} group by part, e),
c{i + 1} as materialized (select * from n{i} union all select c.* from c{i} c anti join n{i} n on c.part = n.part and c.e = n.e),""" for i in range(4))

_COMPONENTS = """e as materialized (select a, b from l union all select b, a from l),
reach as (select {0} as node, {0} as root from v union select e.b, reach.root from reach join e on reach.node = e.a where reach.root < e.b),
groups as (select node, min(root) as component_id from reach group by node)"""

ORACLE = {
    "op1_warc_chunks": f"""
with p as (select page_id, coalesce(html, '') as h, sha1(coalesce(html, '')) as d from pages),
h as (select *, row_number() over (partition by d order by page_id) as n, min(page_id) over (partition by d) as head from p)
select page_id, strlen(h)::bigint as payload_bytes,
  translate(upper({_B32}), '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') as payload_digest,
  case when n = 1 then 'response' else 'revisit' end as record_type,
  case when n > 1 then head end as refers_to
from h""",
    "op3_reply_examples": f"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-1, 0, 'user', '{PROBE}'), (-1, 1, 'assistant', '{PROBE}')),
f as (select *, length('<s>[INST]  [/INST] </s>' || {_ESCAPED.format('role')} || {_ESCAPED.format('text')}) as chars,
  count(*) filter (role = 'assistant') over (partition by conv_id order by turn, role, text
    rows between current row and unbounded following) as replies_after,
  last_value(role) over (partition by conv_id order by turn, role, text rows between unbounded preceding and unbounded following) as final
  from t)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  sum(case when role = 'assistant' then length(text) else 0 end)::bigint as loss_chars,
  sha256(string_agg(case when role = 'assistant' then text else '' end, '' order by turn, role, text)) as loss_sha256,
  sum(chars * (replies_after + case when final = 'assistant' then 0 else 1 end))::bigint as formatted_chars
from f group by conv_id""",
    "op6_source_schedule": """
with d as (select doc_id, source, text is null as none,
    case when text is null then 0 else len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) end::bigint as size,
    md5('mix' || coalesce(doc_id::varchar, '')) as place from documents),
s as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as n from d group by source),
w as (select *, [3.0, 1.0, 2.0][(n - 1) % 3 + 1]::double as weight, (2 * source_size)::double as lim from s),
l as (select *, (sum(source_size) over ()::double * 1.5 - coalesce(sum(lim) over (order by source_size / weight, n rows between unbounded preceding and 1 preceding), 0))
    / (sum(weight) over () - coalesce(sum(weight) over (order by source_size / weight, n rows between unbounded preceding and 1 preceding), 0)) as level from w),
g as (select source, source_size, case when lim <= level * weight then lim else
    (select arg_min(level, (source_size / weight, n)) from l where lim > level * weight) * weight end as target from l),
q as (select *, least(round(target)::bigint, 2 * source_size) as words, (source_size + 511) // 512 as blocks from g),
x as (select d.*, q.source_size, q.target, q.words, coalesce(sum(size) over (partition by d.source order by place, doc_id, size
    rows between unbounded preceding and 1 preceding), 0)::bigint as start
  from d join q on d.source is not distinct from q.source),
y as (select *, words // source_size * blocks + (words % source_size + 511) // 512 as slots from q where source_size > 0),
z as (select source, blocks, slots, coalesce(sum(slots) over (order by source nulls last rows between unbounded preceding and 1 preceding), 0)
    / sum(slots) over () as low, sum(slots) over (order by source nulls last rows unbounded preceding) / sum(slots) over () as high from y where slots > 0),
o as (select range as slot, (range * '0.6180339887498949'::double) % 1::double as point from range((select coalesce(sum(slots), 0)::bigint from y))),
k as (select z.source, slot, blocks, slots, row_number() over (partition by z.source order by slot) - 1 as rank from o join z on point >= low and point < high),
b as (select source, rank % blocks as block, min(slot) as slot from k where rank < slots group by source, rank % blocks),
e as (select x.*, unnest(range(start // 512, (start + size - 1) // 512 + 1)) as block from x where size > 0),
f as (select e.doc_id, e.source, e.start, min(b.slot) as first_slot from e join b on e.source is not distinct from b.source and e.block = b.block
  where words >= source_size or greatest(start, e.block * 512) < words group by e.doc_id, e.source, e.start)
select x.doc_id, size, source_size, target,
  (case when source_size = 0 then 0 else (words // source_size) * size
    + greatest(least(x.start + size, words % source_size) - x.start, 0) end)::bigint as taken, first_slot
from x left join f on size > 0 and x.doc_id is not distinct from f.doc_id and x.source is not distinct from f.source and x.start = f.start""",
    "op4_lyndon_groups": """
with d as materialized (select row_number() over () as r, doc_id, hex(encode(coalesce(text, ''))) as h from documents),
w as materialized (select r, doc_id, i, substr(h, 2 * i + 1, 100) as s from (select *, unnest(range(length(h) // 2 - 49)) as i from d)),
f as (select s, min(doc_id) as head from w group by s having count(*) > 1),
c as (select r, i, case when i - lag(i) over (partition by r order by i) <= 50 then 0 else 1 end as fresh
  from w join f using (s) where head < doc_id),
n as (select r, i, sum(fresh) over (partition by r order by i) as span from c),
p as (select r, min(i) as lo, max(i) + 50 as hi from n group by r, span),
g as (select r, lo, hi, coalesce(lag(hi) over (partition by r order by lo), 0) as before from p),
k as (select g.r, string_agg(substr(h, 2 * before + 1, 2 * (lo - before)), '' order by lo) as kept, max(hi) as final, sum(hi - lo) as removed, count(*) as spans
  from g join d using (r) group by g.r)
select doc_id, (length(h) // 2)::bigint as n_bytes, coalesce(removed, 0)::bigint as n_removed, coalesce(spans, 0)::bigint as n_spans,
  sha256(unhex(case when k.r is null then h else kept || substr(h, 2 * final + 1) end)) as kept_sha256
from d left join k using (r)""",
    "op7_pivot_lists": f"""
with recursive v as materialized (select vec_id, label, embedding::double[] as x from embeddings),
s as materialized (select * from v where label is not null and len(list_filter(x, lambda c: c is null or not isfinite(c))) = 0
  and len(list_filter(x, lambda c: c <> 0)) > 0),
l as materialized (select p.vec_id as a, q.vec_id as b from s p join s q on p.label = q.label and p.vec_id < q.vec_id and len(p.x) = len(q.x)
  where list_cosine_similarity(p.x, q.x) >= 0.98),
{_COMPONENTS.format("vec_id")}
select vec_id, (select count(*) from e where a = vec_id)::bigint as n_links, component_id, vec_id = component_id as kept
from v join groups on vec_id = node""",
    "op10_prefix_join": f"""
with recursive v as materialized (select doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
s as materialized (select distinct doc_id, array_to_string(w[i + 1:i + 5], ' ') as g
  from (select *, unnest(range(greatest(len(w) - 4, least(len(w), 1)))) as i from v)),
n as materialized (select doc_id, count(*) as n from s group by doc_id),
m as (select p.doc_id as a, q.doc_id as b, count(*) as c from s p join s q on p.g = q.g and p.doc_id < q.doc_id group by p.doc_id, q.doc_id),
l as materialized (select a, b from m join n x on a = x.doc_id join n y on b = y.doc_id where 100 * c >= 75 * (x.n + y.n - c)),
{_COMPONENTS.format("doc_id")}
select v.doc_id, coalesce(n.n, 0)::bigint as n_shingles, component_id
from v join groups on v.doc_id = node left join n on v.doc_id = n.doc_id""",
    "op11_lyndon_runs": f"""
with t as (select {_CRC_TABLE} as steps),
d as (select row_number() over () as r, doc_id, {_CRC} as h,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents, t),
a as (select *, len(w) as n, (h // 10) % greatest(len(w), 1) as a, (h // 10) % 8 as m from d),
x as (select r, doc_id, n, case when h % 10 = 0 then list_transform(range(n),
    lambda i: w[case when i < a then i else a + (i - a) % (1 + (n - a) // (3 + m)) end + 1]) else w end as w from a),
g as (select r, i, array_to_string(w[i + 1:i + 6], ' ') as gram from (select r, w, unnest(range(n - 5)) as i from x where n >= 6)),
p as (select y.r, y.i, z.i - y.i as q from g y join g z on y.r = z.r and y.gram = z.gram and y.i < z.i),
s as (select r, q, i, i - row_number() over (partition by r, q order by i) as island from p),
e as (select r, q, min(i) as start, count(*) + 5 + q as length from s group by r, q, island),
u as (select r, start, length, min(q) as period from e where length >= 12 and length >= 2 * q group by r, start, length),
b as (select r, count(*) as n_runs, min((-length, start, period)) as best,
    string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as listed from u group by r),
o as (select distinct r, unnest(range(start + period, start + length)) as i from u),
k as (select w.r, string_agg(w.word, ' ' order by w.i) as collapsed
  from (select r, unnest(range(n)) as i, unnest(w) as word from x) w left join o on w.r = o.r and w.i = o.i where o.r is null group by w.r)
select x.doc_id, coalesce(n_runs, 0)::bigint as n_runs, best[2]::bigint as start, (-best[1])::bigint as length, best[3]::bigint as period,
  (-1000 * best[1] // best[3])::bigint as exponent_milli, sha256(coalesce(listed, '')) as runs_sha256, sha256(coalesce(collapsed, '')) as collapsed_sha256
from x left join b on x.r = b.r left join k on x.r = k.r""",
    "op12_hilbert_blocks": f"""
with k as materialized (select vec_id, label, row_number() over (order by vec_id) as r,
    list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v
  from embeddings where len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as materialized (select r, part, v[part * len(v) // 4 + 1:(part + 1) * len(v) // 4] as x from k, range(4) t(part)),
c0 as materialized (select part, r - 1 as e, x from p where r <= 256),
{_LLOYD}
a4 as materialized ({_NEAREST.format(4)})
select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error,
  (select sha256(string_agg(array_to_string(x, ','), ',' order by part, e)) from c4) as codebooks_sha256
from k join (select r, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' order by part) as code, sum(d)::bigint as error from a4 group by r) using (r)""",
}
