"""The catalogue's queries as SQL for DuckDB; a constant for each, named as the query in capitals."""

from __future__ import annotations

from ..operators.chunk import MAX_BYTES, MAX_CHARS
from ..operators.keyword import grams, terms

ASKED, WORD = "thndou entily the", "thand"

TEXTS = """texts as (
  select source || '/' || doc_id as path, 'doc' as chunk_id, text, lang as doc_type, source as section_title, n_chars as mtime_ns, doc_id from documents)"""
CHUNKS = TEXTS + ",\nchunks as (select t.*, e.embedding as vector from texts t join embeddings e on t.doc_id = e.vec_id)"
QUERY_VECTOR = "(select embedding from embeddings where vec_id = 0)"


def l2(a: str, b: str) -> str:
    return f"list_sum(list_transform(range(1, len({a}) + 1), lambda i: ({a}[i]::double - {b}[i]::double) * ({a}[i]::double - {b}[i]::double)))"


def dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(range(1, len({a}) + 1), lambda i: {a}[i]::double * {b}[i]::double))"


def nearest(rows: str, columns: str, k: int, where: str = "true", with_: str = "", ties: str = "path") -> str:
    return f"""with {with_}q as (select {QUERY_VECTOR} as v),
d as (select r.*, {l2('r.vector', 'q.v')} as distance from {rows} r, q where {where})
select {columns}, round(1 / (1 + distance), 6) as score from d order by distance, {ties} limit {k}"""


VECTORS = "vectors as (select cast(vec_id as varchar) as path, label, embedding as vector from embeddings), "
VECTOR_KNN_L2 = nearest("vectors", "path, label", 8, with_=VECTORS)
IMAGE_KNN = nearest("vectors", "path, label as page_num", 5, with_=VECTORS)
VECTOR_KNN_PREFILTER_DOC_TYPE = nearest("chunks", "path, doc_type", 8, "doc_type = 'de'", CHUNKS + ", ")
VECTOR_KNN_PREFILTER_PATH = nearest("chunks", "path", 8, "contains(path, 'src1')", CHUNKS + ", ")
VECTOR_KNN_BATCH = f"""with d as (
  select q.vec_id as query_id, cast(e.vec_id as varchar) as path, {l2('e.embedding', 'q.embedding')} as distance
  from embeddings q, embeddings e where q.vec_id % 100 = 0),
r as (select *, cast(row_number() over (partition by query_id order by round(distance, 12), path) as int) as rank from d)
select query_id, rank, path, round(1 / (1 + distance), 6) as score from r where rank <= 8"""
VECTOR_KNN_COSINE = f"""with q as (select {QUERY_VECTOR} as v),
c as (select cast(vec_id as varchar) as path, greatest(0.0, least(1.0, {dot('embedding', 'q.v')} / (sqrt({dot('embedding', 'embedding')}) * sqrt({dot('q.v', 'q.v')})))) as cosine from embeddings, q)
select path, round(cosine, 6) as cosine from c order by c.cosine desc, path limit 8"""
VECTOR_DIM_CHECK = "select cast(len(embedding) as int) as dim, count(*) as n from embeddings group by 1"
ZERO_VECTOR_FILTER = """select count(*) filter (where z) as zero, count(*) filter (where not z) as other
from (select len(list_filter(embedding, lambda x: x <> 0)) = 0 as z from embeddings)"""


def tf(gram: str) -> str:
    """Occurrences of a gram in l. Replacing counts those that don't overlap, which are all if no
    beginning of the gram is also its end."""
    assert not any(gram[:i] == gram[-i:] for i in range(1, len(gram)))
    return f"((length(l) - length(replace(l, '{gram}', ''))) // {len(gram)})"


LENGTH = "greatest(length(l) - 1, 0) + greatest(length(l) - 2, 0) + greatest(length(l) - 3, 0)"


def bm25(rows: str, term: str, name: str, where: str = "true", with_: str = "") -> str:
    """CTEs that end in `name`: path, chunk_id, text and bm25 of rows with a positive score, and their rank."""
    g = grams(term)
    tfs = ", ".join(f"{tf(x)} as t{i}" for i, x in enumerate(g))
    dfs = ", ".join(f"count(*) filter (where t{i} > 0) as f{i}" for i in range(len(g)))
    score = " + ".join(f"ln(1 + (n - f{i} + 0.5) / (f{i} + 0.5)) * t{i} * 2.2 / (t{i} + 1.2 * (0.25 + 0.75 * dl / mean))" for i in range(len(g)))
    return f"""{with_}{name}_l as (select path, chunk_id, text, lower(text) as l from {rows}),
{name}_t as (select path, chunk_id, text, ({LENGTH})::double as dl, {tfs} from {name}_l),
{name}_s as (select count(*)::double as n, avg(dl) as mean, {dfs} from {name}_t),
{name}_b as (select path, chunk_id, text, {score} as bm25 from {name}_t, {name}_s where {where}),
{name} as (select *, cast(row_number() over (order by bm25 desc, path, chunk_id) as int) as rank from {name}_b where bm25 > 0)"""


def with_bm25(where: str = "true") -> str:
    return f"with {bm25('texts', WORD, 'b', where, TEXTS + ', ')} select path, rank, round(bm25, 6) as bm25 from b where rank <= 24"


KEYWORD_BM25 = with_bm25()
KEYWORD_BM25_PATH_FILTER = with_bm25("contains(path, 'src1')")
KEYWORD_LIKE_FALLBACK = f"with {TEXTS} select path, cast(row_number() over (order by path, chunk_id) as int) as rank from texts where contains(text, '{WORD}') order by path, chunk_id limit 24"


def recalled(query: str, rows: str, name: str, where: str = "true") -> str:
    """CTEs that end in `name`: path, text, term_pos, kw_rank of the keyword recall of 24 for each term."""
    asked = terms(query)
    parts = ",\n".join(bm25(rows, t, f"{name}{i}", where) for i, t in enumerate(asked))
    union = " union all ".join(f"select path, chunk_id, text, {i} as term_pos, rank from {name}{i} where rank <= 24" for i in range(len(asked)))
    return f"""{parts},
{name}_u as ({union}),
{name}_f as (select *, row_number() over (partition by path, chunk_id order by term_pos, rank) as n from {name}_u),
{name} as (select path, text, term_pos, cast(row_number() over (order by term_pos, rank) as int) as kw_rank from {name}_f where n = 1)"""


KEYWORD_MULTI_TERM = f"with {TEXTS}, {recalled(ASKED, 'texts', 'k')} select path, term_pos, kw_rank from k"
NGRAM_DOC_LENGTH = f"with {TEXTS}, l as (select path, lower(text) as l from texts) select path, cast({LENGTH} as bigint) as dl from l"
NGRAM_POSTINGS = """with l as (select p_partkey, lower(p_name) as l from part), sizes as (select unnest([2, 3, 4]) as n),
g as (select p_partkey, substr(l, i, n) as gram from (select p_partkey, l, n, unnest(range(1, length(l) - n + 2)) as i from l, sizes)),
p as (select gram, p_partkey, count(*) as tf from g group by all)
select gram, count(*) as df, cast(sum(tf) as bigint) as cf from p group by gram"""


def fused(where: str = "true", weight: str = "0.4") -> str:
    """CTEs that end in `fused`. The catalogue's query has under five words, no fact, quote or question."""
    return f"""with {CHUNKS}, q as (select {QUERY_VECTOR} as v),
d as (select path, text, {l2('vector', 'q.v')} as distance from chunks, q where {where}),
sem as (select path, text, distance, cast(row_number() over (order by distance, path) as int) as sem_rank from d order by distance, path limit 24),
{recalled(ASKED, 'chunks', 'k', where)},
fused as (
  select coalesce(s.path, k.path) as path, coalesce(s.text, k.text) as text, sem_rank, kw_rank,
    {weight} * coalesce(1.0::double / (60 + sem_rank), 0) + (1 - {weight}) * coalesce(1.0::double / (60 + kw_rank), 0) as rrf_score,
    case when sem_rank is null then 'keyword' when kw_rank is null then 'semantic' else 'hybrid' end as source,
    coalesce(round(1 / (1 + distance), 6), 0) as score
  from sem s full outer join k on s.path = k.path),
ordered as (select *, cast(row_number() over (order by rrf_score desc, sem_rank nulls last, kw_rank nulls last) as int) as place from fused)"""


BY = "case when source = 'keyword' then 'keyword' else 'embedding' end"
RRF_FUSION = fused() + " select path, sem_rank, kw_rank, round(rrf_score, 6) as rrf_score, source from fused"
HYBRID_TOPK = fused() + f" select place as rank, path, round(rrf_score, 6) as rrf_score, source, {BY} as ranked_by from ordered where place <= 8"
HYBRID_PATH_FILTER = fused("contains(path, 'src2')") + " select place as rank, path, source from ordered where place <= 8"
HYBRID_MODE_SEMANTIC = fused() + " select sem_rank as rank, path, round(1 / (1 + distance), 6) as score, 'embedding' as ranked_by from sem where sem_rank <= 8"
HYBRID_MODE_KEYWORD = fused() + " select kw_rank as rank, path, 0.0::double as score, 'keyword' as ranked_by from k where kw_rank <= 8"

DEDUP_KEY = """select source || '/' || doc_id as path,
  md5(case when length(text) % 2 = 0 then source || '/' || doc_id || chr(0) || 'doc' else source || '/' || doc_id || '#' || substr(sha256(text), 1, 16) end) as key from documents"""
DEDUP_KEEP_FIRST = "select min(doc_id) as doc_id, substr(sha256(text), 1, 16) as key from documents group by 2"
MULTI_QUERY_MERGE = f"""with {TEXTS}, {recalled('thand', 'texts', 'a')}, {recalled('entily', 'texts', 'b')},
u as (select path, 0 as query_pos, 1.0::double / (60 + kw_rank) as score from a union all select path, 1, 1.0::double / (60 + kw_rank) from b),
r as (select *, row_number() over (partition by path order by score desc, query_pos) as n from u)
select path, query_pos, round(score, 6) as score from r where n = 1"""
CROSS_KB_TOPK = f"""with {TEXTS}, talk as (select conv_id || '/' || turn as path, 'turn' as chunk_id, text from conversations),
web as (select url as path, 'p' || page_id as chunk_id, html as text from pages),
{bm25('talk', WORD, 'a')}, {bm25('texts', WORD, 'b')}, {bm25('web', WORD, 'c')},
u as (select 'conversations' as kb, path, chunk_id, bm25 from a where rank <= 8 union all select 'documents', path, chunk_id, bm25 from b where rank <= 8 union all select 'pages', path, chunk_id, bm25 from c where rank <= 8),
r as (select *, cast(row_number() over (order by round(bm25, 6) desc, kb, path, chunk_id) as int) as rank from u)
select rank, kb, path, round(bm25, 6) as bm25 from r where rank <= 8"""


def tokens(text: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({text}), '[A-Za-z0-9_]{{2,}}|[一-鿿]'))"


def jaccard(a: str, b: str) -> str:
    return f"case when len({a}) = 0 or len({b}) = 0 then 0.0 else round(len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))), 6) end"


RERANKED = fused() + f""", t as (select *, {tokens('text')} as a, {tokens("'" + ASKED + "'")} as b from ordered where place <= 24),
rated as (select *, ({jaccard('a', 'b')})::double as rerank_score from t),
best as (select *, cast(row_number() over (order by rerank_score desc, place) as int) as rank from rated)"""
RERANK_LEXICAL = RERANKED + " select rank, path, rerank_score as score, 'rerank' as ranked_by from best where rank <= 8"
RERANK_FALLBACK = fused() + f" select place as rank, path, round(rrf_score, 6) as score, {BY} as ranked_by from ordered where place <= 8"
EXPLAIN_COLUMNS = RERANKED + " select path, source, 'rerank' as ranked_by, 6 as parts from best where rank <= 8"
JACCARD_TURNS = f"""with t as (select conv_id, turn, {tokens('text')} as a, lag({tokens('text')}) over (partition by conv_id order by turn) as b from conversations)
select conv_id, turn, ({jaccard('a', 'b')})::double as jaccard from t where b is not null"""
TRACE_STAGES = RERANKED + """ select 'semantic_recall' as stage, count(*) as n, max(sem_rank) as last from fused where sem_rank is not null
union all select 'keyword_recall', count(*), max(kw_rank) from fused where kw_rank is not null
union all select 'rrf_fusion', count(*), max(place) from ordered where place <= 24
union all select 'rerank', count(*), max(rank) from best where rank <= 8
union all select 'final_results', count(*), max(rank) from best where rank <= 8
union all select unnest(['query_processing', 'deduplication', 'total_time_ms']), 1, 1"""
RESULT_FORMAT = fused() + """ select k.path, md5('[' || kw_rank || '] ' || c.section_title || ' > ' || k.path || ' (score=0.0000, keyword)' || chr(10) ||
  array_to_string(list_transform(string_split(k.text, chr(10)), lambda x: '    ' || x), chr(10))) as md5
from k join chunks c on c.path = k.path where kw_rank <= 8"""
PARENT_CONTEXT = f"""with {TEXTS}, c as (select path, text as doc, substr(text, 601, 300) as t from texts where length(text) > 600),
a as (select *, instr(doc, substr(t, 1, 120)) as i from c)
select path, md5(substr(doc, greatest(1, i - 50), (i - greatest(1, i - 50)) + length(t) + 50)) as md5 from a"""

FACT = r"[0-9]{4}\s*年|[0-9]{1,2}\s*月|[0-9]+\s*[%％]|\b[0-9]{2,}\b|[A-Z][a-zA-Z]+(\s+[A-Z][a-zA-Z]+)+"
QUESTION = "什么是|如何|为什么|怎么|怎样|哪些|解释|介绍|区别|原理|定义|谈谈|分析"
# \b is replaced by what the engine means: no letter, digit or _ beside it; RE2 cannot look around
BOUNDED_FACT = FACT.replace(r"\b[0-9]{2,}\b", r"(^|[^\p{L}\p{N}_])[0-9]{2,}($|[^\p{L}\p{N}_])")
TURNS = "turns as (select *, coalesce(lag(text) over (partition by conv_id order by turn), '') as context from conversations), u as (select * from turns where role = 'user')"
UNITS = r"greatest(len(regexp_extract_all(text, '[一-鿿]')), len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')))"
QUERY_FEATURES = f"""with {TURNS}, f as (select conv_id, turn, cast({UNITS} as bigint) as units,
  regexp_matches(text, '{BOUNDED_FACT}') or regexp_matches(text, '["''“”‘’「」『』]') as fact, regexp_matches(text, '{QUESTION}') as question from u)
select conv_id, turn, units, (case when fact then 0.2 when question then 0.6 when units < 5 then 0.4 when units > 15 then 0.7 else 0.5 end)::double as semantic_weight from f"""
QUERY_ROUTE = f"""with {TURNS}, f as (select regexp_matches(text, '{BOUNDED_FACT}') as fact, regexp_matches(text, '{QUESTION}') as question from u)
select case when fact and not question then 'keyword' when question and not fact then 'semantic' else 'hybrid' end as route, count(*) as n from f group by 1"""
QUERY_DISAMBIGUATE = rf"""with {TURNS}, s as (select conv_id, turn, substr(text, 1, cast(turn % 4 as int)) as short, context,
  list_filter(regexp_split_to_array(context, '[，。！？；：、,.!?;:\s]+'), lambda x: length(x) > 1) as p from u)
select conv_id, turn, case when trim(context, E' \t\n\r') = '' then short
  when regexp_matches(short, '它|他|她|这个|那个|这些|那些|其|该') or length(short) < 3 then trim(case when len(p) > 0 then p[-1] else trim(context, E' \t\n\r') end || ' ' || short)
  else short end as query from s"""

MARKDOWN = """md as (select doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: case when (i - 1) % 4 = 0 then '## ' || x else x end), chr(10) || chr(10)) as text from documents)"""
STRIPPED = r"regexp_replace(x, '^\s+|\s+$', '', 'g')"
CHUNK_SECTIONS = rf"""with {MARKDOWN}, s as (
  select doc_id, list_filter(list_transform(string_split(regexp_replace(text, '(?m)^(#{{1,6}}\s)', chr(1) || '\1', 'g'), chr(1)), lambda x: {STRIPPED}), lambda x: x <> '') as p from md)
select doc_id, cast(i - 1 as int) as pos, md5(p[i]) as md5 from (select doc_id, p, unnest(range(1, len(p) + 1)) as i from s)"""
CHUNK_PARAGRAPHS = rf"""with {MARKDOWN}, s as (
  select doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda x: {STRIPPED}), lambda x: x <> '') as p from md)
select doc_id, cast(i - 1 as int) as pos, md5(p[i]) as md5 from (select doc_id, p, unnest(range(1, len(p) + 1)) as i from s)"""


def is_table(text: str) -> str:
    lines = rf"string_split(regexp_replace({text}, '^\s+|\s+$', '', 'g'), chr(10))"
    return rf"(len({lines}) >= 2 and len(list_filter({lines}, lambda x: regexp_full_match({STRIPPED}, '\|.*\|'))) / len({lines}) > 0.7)"


CHUNK_FLAGS = rf"""select doc_id, ((length(text) - length(replace(text, '```', ''))) / 3 >= 2 or starts_with(ltrim(text), '```')) as code,
  {is_table("'|' || array_to_string(string_split(text, chr(10)), '|' || chr(10) || '|') || '|'")} as as_table, {is_table('text')} as is_table from documents"""
CHUNK_HARD_SPLIT = f"""with recursive d as (select cast(doc_id as varchar) as path, text from documents where length(text) > 0),
w as (select path, i, strlen(c[i]) as b from (select path, c, unnest(range(1, len(c) + 1)) as i from (select path, string_split(text, '') as c from d))),
p as (select path, i, sum(b) over (partition by path order by i) as bytes from w),
r as (
  select path, 0::bigint as part, 0::bigint as start, 0::hugeint as bytes from d
  union all select r.path, r.part + 1, max(p.i), max(p.bytes)
  from r join p on p.path = r.path and p.i > r.start and p.i <= r.start + {MAX_CHARS} and p.bytes <= r.bytes + {MAX_BYTES} group by r.path, r.part),
s as (select path, part, start, lead(start) over (partition by path order by part) as stop from r)
select path, part, start, md5(substr(text, cast(start + 1 as int), cast(stop - start as int))) as md5 from s join d using (path) where stop is not null"""
CHUNK_HARD_SPLIT_NATIVE = f"""select doc_id, cast(i as int) as part, md5(substr(text, cast(i * {MAX_CHARS} + 1 as int), {MAX_CHARS})) as md5
from (select doc_id, text, unnest(range(0, (length(text) + {MAX_CHARS - 1}) // {MAX_CHARS})) as i from documents where length(text) > 0)"""

SUFFIX = r"lower(regexp_extract(regexp_extract(url, '([^/\\]*)$', 1), '^.+(\.[^.]+)$', 1))"
DOC_TYPE_DETECT = f"""with s as (select {SUFFIX} as suffix from pages)
select case when suffix in ('.html', '.htm', '.md', '.txt', '.csv', '.json', '.xml') then 'text' when suffix = '.pdf' then 'pdf' else 'unknown' end as doc_type, suffix, count(*) as n from s group by all"""
TITLE_EXTRACT = r"""with t as (select doc_id, case when doc_id % 2 = 0 then '# ' || text else text end as t from documents),
h as (select doc_id, list_filter(list_transform(string_split(t, chr(10))[1:20], lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: starts_with(x, '# ')) as h from t)
select doc_id, case when len(h) > 0 then regexp_replace(substr(h[1], 3), '^\s+|\s+$', '', 'g') else 'my note ' || doc_id end as title from h"""
FILE_METADATA = "select doc_id, cast(strlen(text) as bigint) as size, sha256(text) as sha256 from documents"
PAGE_CONCAT = "select conv_id, md5(string_agg('## Page ' || turn || chr(10) || chr(10) || text, chr(10) || chr(10) order by turn, text)) as md5 from conversations group by conv_id"
HTML_TEXT_EXTRACT = r"""select page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))) as md5 from pages"""
PARSE_ERROR_ROWS = "select case when page_id % 2 = 0 then 'text' else 'error' end as doc_type, count(*) as n from pages group by 1"
DESCRIPTION_PREVIEW = "select doc_id, md5(substr(text, 1, 500)) as md5 from documents"
SUMMARY_TRUNCATE = """with t as (select doc_id, case when length(text) > 4000 then substr(text, 1, 4000) || chr(10) || '...[truncated]' else text end as t from documents)
select doc_id, length(t) as n, md5(t) as md5 from t"""
EMBED_HASHING = """with g as (select p_partkey, substr(lower(p_name), i, 3) as gram from (select p_partkey, p_name, unnest(range(1, greatest(2, length(p_name) - 1))) as i from part)),
h as (select p_partkey, ('0x' || substr(md5(gram), 1, 8))::bigint as h from g),
s as (select p_partkey, h % 16 as i, sum(case when (h // 16) % 2 = 0 then 1.0 else -1.0 end)::double as x from h group by all),
n as (select p_partkey, sqrt(sum(x * x)) as norm from s group by 1),
grid as (select p_partkey, unnest(range(0, 16)) as i from part)
select grid.p_partkey, cast(grid.i as int) as i, round(coalesce(case when norm > 0 then x / norm else x end, 0), 6)::double as x
from grid left join s on s.p_partkey = grid.p_partkey and s.i = grid.i left join n on n.p_partkey = grid.p_partkey"""

KB_STATS = "select count(*) as total_chunks, count(distinct source || '/' || doc_id) as unique_files, count(distinct lang) as doc_types from documents"
DOC_TYPE_COUNTS = "select lang as doc_type, count(*) as n from documents group by 1"
MAX_MTIME_BY_PATH = "select cast(user_id as varchar) as path, max(epoch_us(ts)) * 1000 as mtime_ns from events group by 1"
LAST_INDEX_TIME = "select strftime(max(ts), '%Y-%m-%d %H:%M:%S') as at from events"
SLICES = """disk as (select 'doc/' || doc_id as path, n_chars as mtime_ns from documents),
own as (select 'doc/' || d.doc_id as path, n_chars + quality - 1 + toxic as mtime_ns from documents d join labels l on d.doc_id = l.doc_id),
indexed as (select * from own union all select 'page/' || page_id, page_id from pages)"""
FRESHNESS_DIFF = f"""with {SLICES} select case when i.path is null then 'new' when d.path is null then 'deleted' when i.mtime_ns < d.mtime_ns then 'modified' when i.mtime_ns > d.mtime_ns then 'older' else 'fresh' end as status,
  count(*) as n from disk d full outer join indexed i on d.path = i.path group by 1"""
INCREMENTAL_DISCOVERY = f"with {SLICES} select path, mtime_ns from disk d where not exists (select 1 from indexed i where i.path = d.path and i.mtime_ns = d.mtime_ns)"
PRUNE_ORPHANS = f"with {SLICES} select path from indexed where path not in (select path from disk)"
UPSERT_REPLACE_BY_PATH = f"""with {CHUNKS} select path, md5(case when l.doc_id is null then text else 'new' end) as md5, mtime_ns + case when l.doc_id is null then 0 else 1 end as mtime_ns
from chunks c left join (select distinct doc_id from labels) l on l.doc_id = c.doc_id"""
DELETE_BY_PATH = f"with {CHUNKS} select doc_type, count(*) as n from chunks where doc_type <> 'fr' group by 1"
EVENT_COUNTS_BY_DAY = "select strftime(date_trunc('day', ts), '%Y-%m-%d') as day, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2"
STREAM_EVENT_COUNTS = EVENT_COUNTS_BY_DAY
