"""The registered queries over the views of model, and the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import udfs as U
from ..operators import history, objects, provenance, refs, stats, text, trees
from ..sources import stores, wire
from . import model as M
from .shared import scratch, small_batches

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _long(*names: str):
    return [F.col(n).cast("long").alias(n) for n in names]


# --- SQL pieces ------------------------------------------------------------------------------

VERSIONS = """
v as (select conv_id, turn, string_agg(text, chr(10)) over (partition by conv_id order by turn rows between 2 preceding and current row) content,
             max(turn) over (partition by conv_id) head from conversations),
s as (select conv_id, head, head - turn d, string_split(content, chr(10)) a from v),
t as (select conv_id, head, d, case when a[-1] = '' then a[1:len(a) - 1] else a end a from s),
ln as (select conv_id, head, d, unnest(a) line, generate_subscripts(a, 1) line_number from t),
st as (select * from ln where d = 0),
g as (select x.conv_id, x.line, min(t.d) gone from (select distinct conv_id, line from st) x
      join t on t.conv_id = x.conv_id and t.d > 0
      where not exists (select 1 from ln where ln.conv_id = x.conv_id and ln.d = t.d and ln.line = x.line) group by 1, 2),
bl as (select st.conv_id, line_number, st.line, head - (coalesce(gone, head + 1) - 1) turn
       from st left join g on g.conv_id = st.conv_id and g.line = st.line)"""
META = """
e as (select user_id conv_id, event_id % 16 turn, event_type, props, user_id::varchar session_id,
             row_number() over (partition by user_id, event_id % 16 order by ts desc, event_id desc) rn,
             min(ts) over (partition by user_id, event_id % 16) mn from events where event_type <> 'error'),
m as (select conv_id, turn, event_type agent, session_id, json_extract(props, '$.k')::int k, epoch_us(mn) // 1000 created_at from e where rn = 1)"""
GRAPH = """
o as (select o_custkey::varchar repo, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) - 1 n, o_orderpriority || ' ' || o_orderstatus message,
             epoch_us(o_orderdate) // 1000000 author_ts, o_totalprice price from orders),
par as (select repo, n, 0 ord, case when n = 1 then 0 else n - 2 end p from o where n >= 1 union all select repo, n, 1 ord, n - 1 from o where n >= 2 and n % 5 = 0)"""
FILES = """
f as (select r_name || '/' || replace(n_name, '/', '-') || '/' || c_name path, sha1(encode('blob ' || strlen(c_name)) || '\\x00'::blob || encode(c_name)) sha, c_acctbal >= 0 kept,
             r_name r, replace(n_name, '/', '-') n, c_name c, c_custkey
      from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"""
BLOB_SHA = "sha1(encode('blob ' || strlen(text)) || '\\x00'::blob || encode(text))"


# --- blame and provenance --------------------------------------------------------------------


def _blamed(spark: SparkSession, d: str) -> DataFrame:
    v = M.file_versions(spark, d)
    return history.blame_commits(v.withColumnRenamed("turn", "commit"), None)


def _metadata(spark: SparkSession, d: str) -> DataFrame:
    e = M.provenance_events(spark, d)
    return provenance.upsert(e, ["key", "turn"], ["agent", "session_id", "k"], ["ts", "event_id"], "ms").withColumnRenamed("ms", "created_at")


@query("J1_blame_with_provenance", f"with {VERSIONS}, {META} select bl.conv_id, line_number, bl.line, bl.turn, agent, k, created_at from bl left join m on m.conv_id = bl.conv_id and m.turn = bl.turn")
def blame_with_provenance(spark, d):
    b = _blamed(spark, d).withColumnRenamed("commit", "turn")
    met = provenance.with_provenance(b, _metadata(spark, d), ["key", "turn"])
    return met.select(F.col("key").alias("conv_id"), "line_number", "line", "turn", "agent", "k", "created_at")


@query("G3_blame", f"with {VERSIONS} select conv_id, line_number, line, turn from bl")
def blame(spark, d):
    return _blamed(spark, d).select(F.col("key").alias("conv_id"), "line_number", "line", F.col("commit").alias("turn"))


@query("G3_blame_depth_1", f"with {VERSIONS} select st.conv_id, line_number, st.line, case when exists (select 1 from ln where ln.conv_id = st.conv_id and ln.d = 1 and ln.line = st.line) then head - 1 else head end turn from st")
def blame_capped(spark, d):
    v = M.file_versions(spark, d).withColumnRenamed("turn", "commit")
    return history.blame_commits(v, 1).select(F.col("key").alias("conv_id"), "line_number", "line", F.col("commit").alias("turn"))


@query("A7_blame_by_agent", f"with {VERSIONS}, {META} select agent, count(*) as lines, count(*) / sum(count(*)) over () share from bl left join m on m.conv_id = bl.conv_id and m.turn = bl.turn group by agent")
def blame_by_agent(spark, d):
    return stats.share_by(blame_with_provenance(spark, d), "agent")


@query("A1_blame_commits", f"with {VERSIONS} select distinct conv_id, turn from bl")
def blame_distinct(spark, d):
    return blame(spark, d).select("conv_id", "turn").distinct()


@query("M1_upsert", f"with {META} select conv_id, turn, agent, session_id, k, created_at from m")
def upsert(spark, d):
    return _metadata(spark, d).select(F.col("key").alias("conv_id"), "turn", "agent", "session_id", "k", "created_at")


PROMPTS = """
w as (select case when turn = 0 then 'shared-' || (conv_id % 10) else substr(sha256(text), 1, 16) end prompt_id, text, conv_id, turn, sha256(text) h, strlen(text)::bigint size_bytes from conversations where role = 'user'),
fst as (select *, first_value(h) over (partition by prompt_id order by conv_id, turn) fh, row_number() over (partition by prompt_id order by conv_id, turn) rn from w)"""


@query("M2_prompt_outcomes", f"with {PROMPTS} select prompt_id, conv_id, turn, h text_hash, size_bytes, case when rn = 1 then 201 when h = fh then 200 else 409 end::bigint status, rn > 1 and h = fh dedup from fst")
def prompt_outcomes(spark, d):
    return provenance.insert_prompts(M.prompt_writes(spark, d), ["conv_id", "turn"])[1].drop("error")


@query("M2_prompt_store", f"with {PROMPTS} select prompt_id, text, h text_hash, size_bytes from fst where rn = 1")
def prompt_store(spark, d):
    return provenance.insert_prompts(M.prompt_writes(spark, d), ["conv_id", "turn"])[0].select("prompt_id", "text", "text_hash", "size_bytes")


@query("J9_prompt_text", f"with {PROMPTS} select w.conv_id, w.turn, w.prompt_id, fst.text from w left join fst on fst.prompt_id = w.prompt_id and fst.rn = 1")
def prompt_text(spark, d):
    writes = M.prompt_writes(spark, d)
    stored = provenance.insert_prompts(writes, ["conv_id", "turn"])[0].select("prompt_id", "text")
    return writes.drop("text").join(stored, "prompt_id", "left").select("conv_id", "turn", "prompt_id", "text")


@query("M3_lookup", f"with {META} select conv_id, turn, agent from m where conv_id = 7 and turn = 3")
def lookup(spark, d):
    m = _metadata(spark, d).select(F.col("key").cast("string").alias("repo_id"), F.col("turn").cast("string").alias("commit_sha"), F.col("key").alias("conv_id"), "turn", "agent")
    return provenance.lookup(m, "7", "3").select("conv_id", "turn", "agent")


@query("M4_prompt_lookup", f"with {PROMPTS} select prompt_id, text from fst where rn = 1 and prompt_id = 'shared-3'")
def prompt_lookup(spark, d):
    return provenance.prompt(prompt_store(spark, d), "shared-3").select("prompt_id", "text")


@query("M7_by_session", f"with {META} select conv_id, turn, session_id from m where session_id = '11'")
def by_session(spark, d):
    return provenance.by_key(upsert(spark, d), session_id="11").select("conv_id", "turn", "session_id")


@query("M7_by_prompt", f"with {PROMPTS} select prompt_id, conv_id, turn from w where prompt_id = 'shared-5'")
def by_prompt(spark, d):
    return provenance.by_key(M.prompt_writes(spark, d), prompt_id="shared-5").select("prompt_id", "conv_id", "turn")


@query("M7_repo_agent", f"with {META} select conv_id, turn, agent from m where conv_id = 7 and agent = 'purchase'")
def repo_agent(spark, d):
    return provenance.by_key(upsert(spark, d).where("conv_id = 7"), agent="purchase").select("conv_id", "turn", "agent")


@query("M7_recent", f"with {META} select conv_id, turn, agent, created_at, row_number() over (partition by conv_id order by created_at desc, turn, agent) as rank from m qualify row_number() over (partition by conv_id order by created_at desc, turn, agent) <= 3")
def recent(spark, d):
    return provenance.recent(upsert(spark, d).select("conv_id", "turn", "agent", "created_at"), ["conv_id"], "created_at", 3)


@query("J10_line_ranges", "select doc_id, line_number, line_start, line_end from (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) line_number from documents) join (select doc_id, 10 * quality + 1 line_start, 10 * quality + 10 line_end from labels) using (doc_id) where line_number between line_start and line_end")
def line_ranges(spark, d):
    lines = M.table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).select("doc_id", (F.col("i") + 1).cast("long").alias("line_number"))
    q = F.col("quality")
    ranges = M.table(spark, d, "labels").select("doc_id", (10 * q + 1).alias("line_start"), (10 * q + 10).alias("line_end"))
    return provenance.lines_in_ranges(lines, ranges, ["doc_id"])


VALID = """
select page_id, lower(repo_id) repo_id, commit_sha, case
  when repo_id is null or repo_id = '' then 'repo_id must be a non-empty string'
  when length(repo_id) > 1024 then 'repo_id too long (max 1024)'
  when commit_sha is null or not regexp_full_match(commit_sha, '[0-9a-f]{40}') then 'commit_sha must be 40 lowercase hex characters'
  when length(model) > 512 then 'model too long (max 512)'
  when metadata_json is not null and not json_valid(metadata_json) then 'metadata_json must be valid JSON when provided as a string' end error
from (select page_id, case when page_id % 11 = 0 then '' when page_id % 11 = 1 then repeat('r', 1025) else url end repo_id,
             case when page_id % 7 = 0 then upper(sha1(url)) when page_id % 7 = 1 then null else sha1(url) end commit_sha,
             repeat('m', (page_id % 13 * 50)::int) model,
             case when page_id % 5 = 0 then '{"a": ' when page_id % 5 = 1 then '{"a": 1}' end metadata_json from pages)"""


@query("F9_validate", VALID)
def validate(spark, d):
    p, i = M.table(spark, d, "pages"), F.col("page_id")
    rows = p.select(
        "page_id",
        F.when(i % 11 == 0, "").when(i % 11 == 1, F.repeat(F.lit("r"), F.lit(1025))).otherwise(F.col("url")).alias("repo_id"),
        F.when(i % 7 == 0, F.upper(F.sha1("url"))).when(i % 7 != 1, F.sha1("url")).alias("commit_sha"),
        F.repeat(F.lit("m"), (i % 13 * 50).cast("int")).alias("model"),
        F.when(i % 5 == 0, '{"a": ').when(i % 5 == 1, '{"a": 1}').alias("metadata_json"),
    )
    return provenance.validate(rows).select("page_id", "repo_id", "commit_sha", "error")


@query("F10_prompt_validate", "select doc_id, case when strlen(t) = 0 then 'text must be non-empty' when strlen(t) > 65536 then 'text too large (' || strlen(t) || ' > 65536 bytes)' end error, strlen(t)::bigint as bytes, length(t)::bigint chars from (select doc_id, case when doc_id % 9 = 0 then '' when doc_id % 9 = 1 then repeat(text, 60) else text end t from documents)")
def prompt_validate(spark, d):
    i = F.col("doc_id")
    rows = M.table(spark, d, "documents").select("doc_id", F.when(i % 9 == 0, "").when(i % 9 == 1, F.repeat("text", F.lit(60))).otherwise(F.col("text")).alias("t"))
    return rows.select("doc_id", C.prompt_error(F.lit("p"), F.col("t")).alias("error"), F.octet_length("t").cast("long").alias("bytes"), F.length("t").cast("long").alias("chars"))


@query("P13_api_shape", f"with {META} select conv_id, turn, k % 2 = 1 human_edited, k::bigint k from m")
def api_shape(spark, d):
    m = upsert(spark, d).select("conv_id", "turn", (F.col("k") % 2).alias("human_edited"), F.to_json(F.struct("k")).alias("metadata_json"))
    return provenance.api_shape(m).select("conv_id", "turn", "human_edited", F.try_variant_get("metadata_json", "$.k", "bigint").alias("k"))


@query("S22_hooks", "select user_id::varchar repo_id, sha1(event_id::varchar) commit_sha, 'hook' agent, user_id::varchar session_id, case when event_type <> 'view' then '{\"tool\":\"' || event_type || '\"}' end metadata_json from events where event_type <> 'signup'")
def hooks(spark, d):
    e = M.table(spark, d, "events")
    tool = F.when(F.col("event_type") != "view", F.col("event_type"))
    payload = F.to_json(F.struct(F.col("user_id").cast("string").alias("session_id"), tool.alias("tool_name")))
    rows = e.select(F.when(F.col("event_type") != "signup", F.col("user_id").cast("string")).alias("repo_id"), F.sha1(F.col("event_id").cast("string")).alias("commit_sha"), payload.alias("payload"))
    return provenance.hook_to_metadata(rows, "hook")


@query("S23_notes_import", "select 'r' repo_id, sha1(conv_id || '/' || turn) commit_sha, 'notes' agent, 's' || conv_id session_id, '{\"tool\":\"' || role || '\"}' metadata_json from conversations where turn > 1")
def notes(spark, d):
    c = M.table(spark, d, "conversations")
    note = F.to_json(F.struct(F.concat(F.lit("s"), "conv_id").alias("sessionId"), F.col("role").alias("tool")))
    rows = c.select(F.sha1(F.concat_ws("/", "conv_id", "turn")).alias("commit_sha"), F.col("turn").alias("commit_ts"), note.alias("note"))
    return provenance.notes_to_metadata(rows, F.lit("r"), "notes", F.lit(1))


# --- contents --------------------------------------------------------------------------------


@query("X2_blob_ids", f"select doc_id, {BLOB_SHA} sha, sha256(text) sha256, strlen(text)::bigint size from documents")
def blob_ids(spark, d):
    return M.blobs(spark, d).select("doc_id", "sha", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("size"))


GREP = "select source || '/' || lang || '/' || doc_id || '.txt' path, {sha} sha, line_number, line, m is_match from (select *, max(m) over (partition by doc_id order by line_number rows between {c} preceding and {c} following) near from (select doc_id, text, source, lang, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) line_number, regexp_matches(unnest(string_split(text, chr(10))), '{p}') m from documents)) where near"
PATTERN = "[Ll]icense|@"


@query("X15_grep", GREP.format(sha=BLOB_SHA, c=0, p=PATTERN))
def grep(spark, d):
    return text.grep(M.blobs(spark, d), PATTERN)


@query("X15_grep_context", GREP.format(sha=BLOB_SHA, c=2, p=PATTERN))
def grep_context(spark, d):
    return text.grep(M.blobs(spark, d), PATTERN, 2)


@query("A3_grep_files", f"select path, sha, count(*) as lines, min(line_number) as first_line from ({GREP.format(sha=BLOB_SHA, c=1, p=PATTERN)}) group by 1, 2")
def grep_files(spark, d):
    found = text.grep_files(M.blobs(spark, d), PATTERN, 1)
    return found.select("path", "sha", F.size("lines").cast("long").alias("lines"), F.element_at("lines", 1)["line_number"].alias("first_line"))


@query("F4_binary", "select doc_id, doc_id % 7 = 0 and strlen(text) < 8192 is_binary from documents")
def binary(spark, d):
    nul = F.when(F.col("doc_id") % 7 == 0, F.expr("unhex('00')")).otherwise(F.expr("unhex('')"))
    b = M.table(spark, d, "documents").select("doc_id", F.concat(F.col("text").cast("binary"), nul, F.col("text").cast("binary")).alias("content"))
    return b.select("doc_id", C.is_binary(F.col("content")).alias("is_binary"))


@query("S5_read_blobs_cap", f"""
with o as (select doc_id, {BLOB_SHA} sha, text, case when doc_id % 17 = 0 then null when doc_id % 10 = 0 then 'tree' else 'blob' end as type from documents where doc_id % 13 <> 0),
w as (select distinct {BLOB_SHA} sha from documents),
u as (select sha, min(text) text, min(coalesce(type, '')) as type from o group by sha)
select sha, case when err is null then n end size, case when err is null then to_base64(encode(text)) end content_base64, err error
from (select w.sha, text, strlen(text)::bigint n, case when u.sha is null then 'object not found' when type = '' then 'malformed git object header' when type <> 'blob' then 'not a blob (got ' || type || ')' when strlen(text) > 3000 then 'blob exceeds maxBlobBytes (' || strlen(text) || ' > 3000)' end err from w left join u using (sha))""")
def read_blobs(spark, d):
    i = F.col("doc_id")
    b = M.blobs(spark, d).withColumn("repo", F.lit("r"))
    kind = F.when(i % 17 == 0, "").when(i % 10 == 0, "tree").otherwise("blob")
    held = b.where(i % 13 != 0).withColumn("type", kind).groupBy("repo", "sha").agg(F.min("type").alias("type"), F.min("content").alias("content"))
    held = held.withColumn("type", F.nullif(F.col("type"), F.lit("")))
    return objects.read_blobs(b.select("repo", "sha").distinct(), held, 3000).drop("repo")


@query("X14_diff_meta", "select a.doc_id || '.txt' path, case when b.doc_id is null then 'deleted' else 'modified' end status, false is_binary, strlen(a.text)::bigint old_size, strlen(b.text)::bigint new_size from documents a left join documents b on b.doc_id = a.doc_id + 1")
def diff_meta(spark, d):
    return text.diff_meta(M.blob_pairs(spark, d)).drop("old_content", "new_content")


@query("X13_diff_patch")
def diff_patch(spark, d):
    """Patches of consecutive documents."""
    return text.diff_blobs(M.blob_pairs(spark, d))


@query("J4_pairs_by_sha", f"with b as (select doc_id, {BLOB_SHA} sha, strlen(text)::bigint n from documents), u as (select distinct sha, n from b where doc_id % 3 <> 0) select a.doc_id, x.n old_size, y.n new_size from b a join b c on c.doc_id = a.doc_id + 1 left join u x on x.sha = a.sha left join u y on y.sha = c.sha")
def pairs_by_sha(spark, d):
    b = M.blobs(spark, d)
    changes = b.select("doc_id", F.col("sha").alias("old_sha")).join(b.select((F.col("doc_id") - 1).alias("doc_id"), F.col("sha").alias("new_sha")), "doc_id")
    held = b.where(F.col("doc_id") % 3 != 0).select("sha", "content").dropDuplicates(["sha"])
    size = lambda c: F.octet_length(c).cast("long")
    return text.pair_by_sha(changes, held).select("doc_id", size("old_content").alias("old_size"), size("new_content").alias("new_size"))


@query("X12_split_lines", "select doc_id, len(a)::bigint as grep, case when t = '' then 0 else len(a) end::bigint as diff, case when a[-1] = '' then len(a) - 1 else len(a) end::bigint as blame from (select doc_id, t, string_split(t, chr(10)) a from (select doc_id, case when doc_id % 5 = 0 then '' when doc_id % 5 = 1 then text || chr(10) else text end t from documents))")
def split_lines(spark, d):
    i = F.col("doc_id")
    t = M.table(spark, d, "documents").select("doc_id", F.when(i % 5 == 0, "").when(i % 5 == 1, F.concat("text", F.lit("\n"))).otherwise(F.col("text")).alias("t"))
    return t.select("doc_id", *(F.size(C.split_lines(F.col("t"), r)).cast("long").alias(r) for r in ("grep", "diff", "blame")))


@query("W4_line_numbers", "select doc_id, generate_subscripts(string_split(text, chr(10)), 1) line_number, unnest(string_split(text, chr(10))) line from documents")
def line_numbers(spark, d):
    t = M.table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return t.select("doc_id", (F.col("i") + 1).cast("long").alias("line_number"), "line")


@query("X11_bytes", "select doc_id, instr(text, 'e')::bigint - 1 as at, (strlen(text) - strlen(replace(text, 'e', '')))::bigint n, text = reverse(reverse(text)) same from documents")
def byte_scan(spark, d):
    t = M.table(spark, d, "documents")
    return t.select("doc_id", (F.locate("e", F.col("text")) - 1).cast("long").alias("at"), (F.octet_length("text") - F.octet_length(F.replace(F.col("text"), F.lit("e"), F.lit("")))).cast("long").alias("n"), (F.col("text") == F.reverse(F.reverse("text"))).alias("same"))


@query("X4_hex", "select doc_id, lower(hex(encode(text))) h, text back from documents")
def hexed(spark, d):
    t = M.table(spark, d, "documents").select("doc_id", F.lower(F.hex(F.col("text").cast("binary"))).alias("h"))
    return t.select("doc_id", "h", C.text_of(F.unhex("h")).alias("back"))


@query("X19_json", "select event_id, json_extract(props, '$.k')::bigint k, json_valid(case when event_id % 3 = 0 then props || ']' else props end) valid from events")
def json_values(spark, d):
    e = M.table(spark, d, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), C.is_json(F.when(F.col("event_id") % 3 == 0, F.concat("props", F.lit("]"))).otherwise(F.col("props"))).alias("valid"))


# --- addresses and keys ----------------------------------------------------------------------

URLS = """(select page_id, case page_id % 6 when 0 then 'git@' || split_part(split_part(url, '://', 2), '/', 1) || ':u/R' || page_id || '.git' when 1 then 'ssh://git@' || split_part(url, '://', 2) when 2 then replace(url, '://', '://USER:TOKEN@') when 3 then url || '//' when 4 then '  ' else url end u from pages)"""


def _urls(spark, d):
    p = M.table(spark, d, "pages")
    rest = F.split_part("url", F.lit("://"), F.lit(2))
    k = F.col("page_id") % 6
    u = F.when(k == 0, F.concat(F.lit("git@"), F.split_part(rest, F.lit("/"), F.lit(1)), F.lit(":u/R"), "page_id", F.lit(".git"))).when(k == 1, F.concat(F.lit("ssh://git@"), rest)).when(k == 2, F.replace("url", F.lit("://"), F.lit("://USER:TOKEN@"))).when(k == 3, F.concat("url", F.lit("//"))).when(k == 4, F.lit("  ")).otherwise(F.col("url"))
    return p.select("page_id", u.alias("u"))


@query("X16_repo_urls", f"""
with u as (select page_id, trim(u) u from {URLS}),
a as (select page_id, u, case when regexp_matches(u, '^([\\w.-]+)@([\\w.-]+):(.+?)$') then regexp_replace(u, '^([\\w.-]+)@([\\w.-]+):(.+?)$', 'https://\\2/\\3') else regexp_replace(u, '^(ssh|git)://', 'https://') end b from u),
c as (select page_id, u, regexp_replace(regexp_replace(b, '^(https?://)[^@/]+@', '\\1'), '/+$', '') c from a)
select page_id, case when u <> '' then lower(case when lower(c) like '%.git' then c else c || '.git' end) end repo_id from c""")
def repo_urls(spark, d):
    return _urls(spark, d).select("page_id", C.normalize_repo_url(F.col("u")).alias("repo_id"))


@query("X17_repo_keys", f"select page_id, regexp_replace(regexp_replace(lower(u), '^https?://', ''), '[^a-z0-9\\-_./]', '-', 'g') as key from {URLS}")
def repo_keys(spark, d):
    return _urls(spark, d).select("page_id", C.repo_key(F.col("u")).alias("key"))


@query("X22_auth", "select page_id, 'Basic ' || to_base64(encode('x:' || url)) as header from pages")
def auth(spark, d):
    return M.table(spark, d, "pages").select("page_id", F.regexp_replace(C.basic_auth(F.col("url")), "[\r\n]", "").alias("header"))


@query("S25_keys", f"select doc_id, 'r/objects/' || substr(sha, 1, 2) || '/' || substr(sha, 3) loose, 'r/loose/' || sha staged, 'r/worktrees/main/' || doc_id || '.txt' worktree, ('r/loose/' || sha) like 'r/%' in_scope from (select doc_id, {BLOB_SHA} sha from documents)")
def keys(spark, d):
    b, r = M.blobs(spark, d), F.lit("r")
    sha = F.col("sha")
    return b.select("doc_id", C.loose_key(r, sha).alias("loose"), C.staged_key(r, sha).alias("staged"), C.worktree_key(r, F.lit("main"), F.concat("doc_id", F.lit(".txt"))).alias("worktree"), C.in_scope(C.staged_key(r, sha), r).alias("in_scope"))


@query("F1_key_scope", f"select doc_id, 'r/loose/' || sha as key from (select doc_id, {BLOB_SHA} sha from documents)")
def key_scope(spark, d):
    rows = M.blobs(spark, d).select("doc_id", F.lit("r").alias("repo"), C.staged_key(F.lit("r"), F.col("sha")).alias("key"))
    return objects.check_scope(rows, "key", "repo").select("doc_id", "key")


@query("F11_sha_ref_checks", "select doc_id, regexp_full_match(s, '[0-9a-f]{40}') sha_ok, starts_with(r, 'refs/') ref_ok from (select doc_id, case when doc_id % 3 = 0 then upper(sha1(text)) else sha1(text) end s, case when doc_id % 4 = 0 then 'refs/heads/x' else 'heads/x' end r from documents)")
def checks(spark, d):
    i = F.col("doc_id")
    t = M.table(spark, d, "documents").select("doc_id", F.when(i % 3 == 0, F.upper(F.sha1("text"))).otherwise(F.sha1("text")).alias("s"), F.when(i % 4 == 0, "refs/heads/x").otherwise("heads/x").alias("r"))
    return t.select("doc_id", F.col("s").rlike(C.SHA1).alias("sha_ok"), F.col("r").startswith("refs/").alias("ref_ok"))


@query("S20_pkt_encode", "select page_id, lower(lpad(to_hex(strlen(url) + 4), 4, '0')) || url as line from pages")
def pkt(spark, d):
    return M.table(spark, d, "pages").select("page_id", C.pkt_line(F.col("url")).alias("line"))


@query("S10_pack_header_length", "select doc_id, 1 + case when n < 16 then 0 else ceil((length(bin(n)) - 4) / 7) end::bigint as bytes from (select doc_id, strlen(text)::bigint n from documents)")
def header_length(spark, d):
    return M.table(spark, d, "documents").select("doc_id", C.pack_header_length(F.octet_length("text").cast("long")).alias("bytes"))


@query("D1_batches", "select o_orderkey, o_orderkey // 1000 as batch, (o_orderkey // 1000) % 7 as slot from orders")
def batches(spark, d):
    return objects.batches(M.table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 1000, 7)


@query("J2_locations", f"with b as (select doc_id, {BLOB_SHA} sha, strlen(text)::bigint n from documents) select w.doc_id, w.sha, 'chunk-' || (l.doc_id // 50) chunk_key, l.n as length from b w join b l on w.sha = l.sha where l.doc_id % 5 <> 0")
def locations(spark, d):
    b = M.blobs(spark, d).select("doc_id", F.lit("r").alias("repo"), "sha", F.octet_length("content").cast("long").alias("length"))
    places = b.where("doc_id % 5 <> 0").select("repo", "sha", F.concat(F.lit("chunk-"), F.floor(F.col("doc_id") / 50).cast("string")).alias("chunk_key"), "length")
    return objects.locate(b.drop("length"), places).select("doc_id", "sha", "chunk_key", "length")


@query("S3_chunk_groups", "select 'chunk-' || (doc_id // 50) chunk_key, count(*) as objects, sum(strlen(text))::bigint as bytes from documents group by 1")
def chunk_groups(spark, d):
    b = M.blobs(spark, d).select(F.concat(F.lit("chunk-"), F.floor(F.col("doc_id") / 50).cast("string")).alias("chunk_key"), F.octet_length("content").cast("long").alias("n"))
    return b.groupBy("chunk_key").agg(F.count(F.lit(1)).alias("objects"), F.sum("n").alias("bytes"))


@query("S2_chunk_slices", f"select doc_id, {BLOB_SHA} sha from documents")
def chunk_slices(spark, d):
    """Blobs packed into chunks of fifty and cut out again."""
    from pyspark.sql import Window

    b = M.blobs(spark, d).withColumn("chunk_key", F.floor(F.col("doc_id") / 50).cast("string")).withColumn("repo", F.lit("r"))
    w = Window.partitionBy("chunk_key").orderBy("doc_id")
    n = F.octet_length("content").cast("long")
    places = b.select("doc_id", "repo", "sha", "chunk_key", (F.sum(n).over(w) - n).alias("offset"), n.alias("length"))
    hexed_ = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", F.hex("content").alias("h")))), lambda x: x["h"]), "")
    chunks = b.groupBy("repo", "chunk_key").agg(F.unhex(hexed_).alias("content"))
    cut_ = places.join(chunks, ["repo", "chunk_key"]).select("doc_id", F.substring(F.col("content"), (F.col("offset") + 1).cast("int"), F.col("length").cast("int")).alias("data"))
    return cut_.select("doc_id", C.object_id("blob", F.col("data")).alias("sha"))


# --- commits ---------------------------------------------------------------------------------

BODY = """
b as (select conv_id, turn, text, 'tree ' || sha1(text) || chr(10) || case when turn > 0 then 'parent ' || sha1(conv_id || '/' || (turn - 1)) || chr(10) else '' end
             || 'author ' || role || ' <' || role || '@example.org> ' || (1700000000 + turn) || ' +0000' || chr(10) || 'committer ' || role || ' <' || role || '@example.org> ' || (1700000000 + turn) || ' +0000' || chr(10) || chr(10) || text body, role from conversations)"""


def _bodies(spark, d):
    c = M.turn_commits(spark, d)
    parents = F.when(F.col("parent").isNotNull(), F.array("parent")).otherwise(F.array().cast("array<string>"))
    body = C.encode_commit(F.sha1("message"), parents, F.col("author"), F.concat("author", F.lit("@example.org")), F.lit(1700000000) + F.col("turn"), F.col("message"))
    return c.select(F.col("repo").alias("conv_id"), "turn", body.alias("body"))


@query("P10_commit_bytes", f"with {BODY} select conv_id, turn, sha1(encode('commit ' || strlen(body)) || '\\x00'::blob || encode(body)) sha, strlen(body)::bigint size, sha1(text) tree from b")
def commit_bytes(spark, d):
    b = F.col("body").cast("binary")
    return _bodies(spark, d).select("conv_id", "turn", C.object_id("commit", b).alias("sha"), F.octet_length(b).cast("long").alias("size"), C.commit_tree(F.col("body")).alias("tree"))


@query("P3_parse_commits", f"with {BODY} select conv_id, turn, sha1(text) tree, case when turn > 0 then sha1(conv_id || '/' || (turn - 1)) end parent, role author, role || '@example.org' author_email, 1700000000 + turn author_ts, string_split(text, chr(10))[1] summary, text message from b")
def parse_commits(spark, d):
    c = C.parse_commit(F.col("body"))
    p = _bodies(spark, d).select("conv_id", "turn", c.alias("c"))
    return p.select("conv_id", "turn", "c.tree", F.get("c.parents", F.lit(0)).alias("parent"), "c.author", "c.author_email", "c.author_ts", "c.summary", "c.message")


@query("P5_parse_commits_batch", f"with {BODY} select conv_id, turn, case when turn % 4 = 3 then 'object not found' when turn % 4 = 2 then 'not a commit object' end error, case when turn % 4 < 2 then role end author from b")
def parse_batch(spark, d):
    k = F.col("turn") % 4
    o = _bodies(spark, d).select(F.col("conv_id").cast("string").alias("repo"), F.col("turn").cast("string").alias("sha"), F.when(k == 2, "blob").otherwise("commit").alias("type"), F.col("body").cast("binary").alias("content"), k.alias("k"))
    found = objects.parse_commits(o.select("repo", "sha"), o.where("k <> 3"))
    return found.select(F.col("repo").cast("long").alias("conv_id"), F.col("sha").cast("long").alias("turn"), "error", "author")


@query("P1_object_header", f"select doc_id, 'blob' as type, strlen(text)::bigint size, {BLOB_SHA} sha from documents")
def header(spark, d):
    raw = C.serialized(F.lit("blob"), F.col("content"))
    h = M.blobs(spark, d).select("doc_id", C.parse_header(raw).alias("h"))
    return h.select("doc_id", "h.type", "h.size", C.object_id("blob", F.col("h.content")).alias("sha"))


# --- trees -----------------------------------------------------------------------------------


@query("G4_flatten_tree", f"with {FILES} select 'customers' as root, path, '100644' as mode, sha from f")
def flatten(spark, d):
    roots = spark.range(1).select(F.lit("customers").alias("root"), F.lit("root").alias("tree_sha"))
    return trees.flatten(M.tree_entries(spark, d), roots)


@query("G5_resolve_path", f"with {FILES} select path, case when c_custkey % 3 <> 1 then sha end sha from (select case when c_custkey % 3 = 0 then path when c_custkey % 3 = 1 then r || '/' || n || '/none' || c_custkey else '/' || r || '//' || n || '/' || c end path, sha, c_custkey from f)")
def resolve(spark, d):
    f, k = M.customer_files(spark, d), F.col("c_custkey") % 3
    part = lambda i: F.element_at(F.split("path", "/"), i)
    p = F.when(k == 0, F.col("path")).when(k == 1, F.concat_ws("/", part(1), part(2), F.concat(F.lit("none"), "c_custkey"))).otherwise(F.concat(F.lit("/"), part(1), F.lit("//"), part(2), F.lit("/"), part(3)))
    wanted = f.select(F.lit("customers").alias("root"), F.lit("root").alias("tree_sha"), p.alias("path"))
    return trees.resolve(M.tree_entries(spark, d), wanted).select("path", "sha")


@query("F13_path_exists", f"with {FILES} select path, exists (select 1 from f g where g.path = q.path) as there from (select case when c_custkey % 2 = 0 then path else path || '.no' end path from f) q")
def path_exists(spark, d):
    f = M.customer_files(spark, d)
    asked = f.select(F.when(F.col("c_custkey") % 2 == 0, F.col("path")).otherwise(F.concat("path", F.lit(".no"))).alias("path"))
    return asked.join(f.select("path", F.lit(True).alias("there")), "path", "left").select("path", F.coalesce("there", F.lit(False)).alias("there"))


@query("J11_tree_diff", f"with {FILES}, a as (select path, sha from f), b as (select path, case when c_custkey % 10 = 0 then sha1(sha) else sha end sha from f where kept union all select path || '.new', sha from f where c_custkey % 50 = 0) select coalesce(a.path, b.path) path, case when a.sha is null then 'added' when b.sha is null then 'deleted' else 'modified' end status, a.sha old_sha, b.sha new_sha from a full join b on a.path = b.path where a.sha is distinct from b.sha")
def tree_diff(spark, d):
    f = M.customer_files(spark, d)
    new = f.where("kept").select("path", F.when(F.col("c_custkey") % 10 == 0, F.sha1("sha")).otherwise(F.col("sha")).alias("sha"))
    new = new.unionByName(f.where("c_custkey % 50 = 0").select(F.concat("path", F.lit(".new")).alias("path"), "sha"))
    return trees.compare(f.select("path", "sha"), new, ["path"])


TREES = f"""with {FILES},
t3 as (select r, n, sha1(encode('tree ' || octet_length(b)) || '\\x00'::blob || b) sha, b from (select r, n, unhex(string_agg(hex(encode('100644 ' || c)) || '00' || upper(sha), '' order by c)) b from f {{where}} group by r, n)),
t2 as (select r, sha1(encode('tree ' || octet_length(b)) || '\\x00'::blob || b) sha, b from (select r, unhex(string_agg(hex(encode('40000 ' || n)) || '00' || upper(sha), '' order by n || '/')) b from t3 group by r)),
t1 as (select sha1(encode('tree ' || octet_length(b)) || '\\x00'::blob || b) sha, b from (select unhex(string_agg(hex(encode('40000 ' || r)) || '00' || upper(sha), '' order by r || '/')) b from t2))"""


@query("P8_tree_ids", TREES.format(where="") + " select '' path, sha from t1 union all select r, sha from t2 union all select r || '/' || n, sha from t3")
def tree_ids(spark, d):
    f = M.customer_files(spark, d).select("repo", "path", "mode", "sha")
    return trees.build(f, ["repo"])[1].select("path", "sha")


@query("P6_walk_trees", TREES.format(where="") + " select t3.sha, c as name, '100644' as mode, f.sha entry_sha from f join t3 using (r, n) union all select t2.sha, n, '40000', t3.sha from t3 join t2 using (r) union all select t1.sha, r, '40000', t2.sha from t2, t1")
def walk_trees(spark, d):
    f = M.customer_files(spark, d).select("repo", "path", "mode", "sha")
    made = trees.build(f, ["repo"])[1].select("sha", F.lit("tree").alias("type"), "content")
    return trees.walk_trees(made).select("sha", "name", "mode", "entry_sha")


@query("M5_snapshot_write", TREES.format(where="where kept") + " select 'customers' as repo, sha from t1")
def snapshot_write(spark, d):
    """Deleting the customers that the second snapshot lacks gives its root."""
    f = M.customer_files(spark, d)
    gone = f.where("not kept").select("repo", "path", "mode", F.lit(None).cast("binary").alias("content"))
    return trees.change_paths(f.select("repo", "path", "mode", "sha"), gone, ["repo"])[0]


@query("M6_commit_change", TREES.format(where="where kept") + ", b as (select 'tree ' || sha || chr(10) || 'parent ' || sha1('head') || chr(10) || 'author a <a@example.org> 1700000000 +0000' || chr(10) || 'committer a <a@example.org> 1700000000 +0000' || chr(10) || chr(10) || 'change' body from t1) select 'refs/heads/main' as ref, sha1('head') old_sha, sha1(encode('commit ' || strlen(body)) || '\\x00'::blob || encode(body)) new_sha from b")
def commit_change(spark, d):
    heads = spark.range(1).select(F.lit("customers").alias("repo"), F.lit("refs/heads/main").alias("ref"), F.sha1(F.lit("head")).alias("sha"))
    made = trees.commit_change(heads, snapshot_write(spark, d), "repo", F.lit("a"), F.lit("a@example.org"), F.lit(1700000000), F.lit("change"))
    return made.select("ref", "old_sha", "new_sha")


@query("L4_tree_sort", "select doc_id, name, row_number() over (partition by lang, source order by case when dir then name || '/' else name end, doc_id) as pos from (select doc_id, lang, source, substr(sha1(text), 1, 2) || case when doc_id % 3 = 0 then '.x' else '' end as name, doc_id % 2 = 0 dir from documents)")
def tree_sort(spark, d):
    from pyspark.sql import Window

    i = F.col("doc_id")
    t = M.table(spark, d, "documents").select("doc_id", "lang", "source", F.concat(F.substring(F.sha1("text"), 1, 2), F.when(i % 3 == 0, ".x").otherwise("")).alias("name"), F.when(i % 2 == 0, "40000").otherwise("100644").alias("mode"))
    return t.select("doc_id", "name", F.row_number().over(Window.partitionBy("lang", "source").orderBy(C.tree_key(F.col("mode"), F.col("name")), "doc_id")).cast("long").alias("pos"))


@query("P9_entry_change", "select n_nationkey::bigint n_nationkey, len(list_filter(range(4), lambda i: i <> n_nationkey % 4))::bigint removed, 4::bigint replaced from nation")
def entry_change(spark, d):
    e = lambda n: F.struct(F.lit("100644").alias("mode"), n.alias("name"), F.sha1(n).alias("sha"))
    entries = F.array(*(e(F.lit(str(i))) for i in range(4)))
    k = (F.col("n_nationkey") % 4).cast("string")
    n = M.table(spark, d, "nation")
    return n.select(*_long("n_nationkey"), F.size(C.without_entry(entries, k)).cast("long").alias("removed"), F.size(C.with_entry(entries, e(k))).cast("long").alias("replaced"))


@query("R14_merge_snapshots", f"with {FILES}, b as (select path, sha from f), o as (select path, case when c_custkey % 4 = 0 then sha1(sha) else sha end sha from f where c_custkey % 7 <> 0), t as (select path, case when c_custkey % 6 = 0 then sha256(sha) else sha end sha from f where c_custkey % 11 <> 0), x as (select coalesce(b.path, o.path, t.path) path, b.sha b, o.sha o, t.sha t from b full join o on o.path = b.path full join t on t.path = coalesce(b.path, o.path)) select path, case when t is not distinct from b then o else t end sha, (o is distinct from b and t is distinct from b and o is distinct from t) as conflict from x where case when t is not distinct from b then o else t end is not null or (o is distinct from b and t is distinct from b and o is distinct from t)")
def merge_snapshots(spark, d):
    f, k = M.customer_files(spark, d), F.col("c_custkey")
    ours = f.where(k % 7 != 0).select("path", F.when(k % 4 == 0, F.sha1("sha")).otherwise(F.col("sha")).alias("sha"))
    theirs = f.where(k % 11 != 0).select("path", F.when(k % 6 == 0, F.sha2("sha", 256)).otherwise(F.col("sha")).alias("sha"))
    return trees.merge_snapshots(f.select("path", "sha"), ours, theirs, ["path"])


# --- walks -----------------------------------------------------------------------------------

LOG = f"with recursive {GRAPH}, h as (select repo, max(n) n from o group by repo), r as (select repo, n, 0 d from h union select r.repo, par.p, d + 1 from r join par on par.repo = r.repo and par.n = r.n), w as (select repo, n, min(d) d from r group by 1, 2)"


def _heads(commits):
    return commits.groupBy("repo").agg(F.max("n").cast("string").alias("sha")).withColumn("ord", F.lit(0))


@query("G1_log", LOG + " select repo, n::varchar sha, d::bigint as depth from w")
def log(spark, d):
    commits, parents = M.order_graph(spark, d)
    return history.log_walk(parents, _heads(commits), None).select("repo", "sha", "depth")


@query("G1_log_filtered", LOG + " select w.repo, w.n::varchar sha, d::bigint as depth, message from w join o on o.repo = w.repo and o.n = w.n where message like '1-%' and d <= 4")
def log_filtered(spark, d):
    commits, parents = M.order_graph(spark, d)
    walked = history.log_walk(parents, _heads(commits), 4)
    return history.log(walked, commits, F.col("message").like("1-%")).select("repo", "sha", "depth", "message")


@query("L1_log_limit", "select conv_id, turn, row_number() over (partition by conv_id order by turn desc) as rank from conversations where role = 'assistant' qualify row_number() over (partition by conv_id order by turn desc) <= 2")
def log_limit(spark, d):
    c = M.turn_commits(spark, d).withColumn("repo", F.col("repo").cast("string"))
    parents = c.select("repo", "sha", F.lit(0).alias("ord"), "parent")
    heads = c.groupBy("repo").agg(F.max_by("sha", "turn").alias("sha")).withColumn("ord", F.lit(0))
    found = history.log(history.log_walk(parents, heads, None), c, F.col("author") == "assistant", 2)
    return found.select(F.col("repo").cast("long").alias("conv_id"), "turn", "rank")


@query("G2_merge_base", f"""with recursive {GRAPH}, h as (select repo, max(n) a, max(n) - 1 b from o group by repo having max(n) >= 1),
ra as (select repo, a n, 0 d from h union select ra.repo, par.p, d + 1 from ra join par on par.repo = ra.repo and par.n = ra.n),
rb as (select repo, b n, 0 d from h union select rb.repo, par.p, d + 1 from rb join par on par.repo = rb.repo and par.n = rb.n),
da as (select repo, n, min(d) d from ra group by 1, 2), db as (select repo, n, min(d) d from rb group by 1, 2),
c as (select da.repo, da.d + 1 lvl, 0 side, par.p from da join par on par.repo = da.repo and par.n = da.n join db on db.repo = da.repo and db.n = par.p where db.d <= da.d
      union all select db.repo, db.d + 1, 1, par.p from db join par on par.repo = db.repo and par.n = db.n join da on da.repo = db.repo and da.n = par.p where da.d <= db.d + 1)
select h.repo, a::varchar a, b::varchar b, (select p from c where c.repo = h.repo order by lvl, side, p limit 1)::varchar base from h""")
def merge_base(spark, d):
    commits, parents = M.order_graph(spark, d)
    n = commits.groupBy("repo").agg(F.max("n").alias("n")).where("n >= 1")
    return history.merge_base(parents, n.select("repo", F.col("n").cast("string").alias("a"), (F.col("n") - 1).cast("string").alias("b")))


@query("G6_rev_parse", f"with {GRAPH}, h as (select repo, max(n) n from o group by repo) select h.repo, 'HEAD' as name, p2.p::varchar sha from h left join par p1 on p1.repo = h.repo and p1.n = h.n and p1.ord = 0 left join par p2 on p2.repo = h.repo and p2.n = p1.p and p2.ord = 1")
def rev_parse(spark, d):
    commits, parents = M.order_graph(spark, d)
    heads = _heads(commits).select("repo", F.lit("HEAD").alias("name"), "sha")
    return history.rev_parse(parents, heads, "~1^2")


@query("J6_first_parents", f"with recursive {GRAPH}, h as (select repo, max(n) n from o group by repo), r as (select repo, n head, 0 d, n from h union all select r.repo, head, d + 1, par.p from r join par on par.repo = r.repo and par.n = r.n and par.ord = 0) select repo, head::varchar head, d::bigint as depth, n::varchar sha from r")
def first_parents(spark, d):
    commits, parents = M.order_graph(spark, d)
    return history.first_parent_chain(parents, _heads(commits).select("repo", "sha"), None)


@query("R14_log_by_path", f"with v as (select conv_id, turn, sha1(string_agg(role, ',') over (partition by conv_id order by turn rows between 1 preceding and current row)) sha from conversations) select conv_id, turn, sha from (select *, lag(sha) over (partition by conv_id order by turn) b from v) where sha is distinct from b")
def log_by_path(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-1, 0)
    v = M.table(spark, d, "conversations").select(F.col("conv_id").alias("key"), F.col("turn").alias("n"), F.sha1(F.array_join(F.collect_list("role").over(w), ",")).alias("sha"))
    return history.log_by_path(v).select(F.col("key").alias("conv_id"), F.col("n").alias("turn"), "sha")


SIDES = f"with recursive {GRAPH}, h as (select repo, max(n) a, max(n) - 1 b from o group by repo having max(n) >= 1), ra as (select repo, a n from h union select ra.repo, par.p from ra join par on par.repo = ra.repo and par.n = ra.n), rb as (select repo, b n from h union select rb.repo, par.p from rb join par on par.repo = rb.repo and par.n = rb.n)"


def _sides(spark, d):
    commits, parents = M.order_graph(spark, d)
    n = commits.groupBy("repo").agg(F.max("n").alias("n")).where("n >= 1")
    walk = lambda k: history.log_walk(parents, n.select("repo", (F.col("n") - k).cast("string").alias("sha"), F.lit(0).alias("ord")), None).select("repo", "sha")
    return walk(0), walk(1)


@query("U1_union", SIDES + " select repo, n::varchar sha from (select * from ra union select * from rb)")
def union(spark, d):
    a, b = _sides(spark, d)
    return a.union(b).distinct()


@query("U2_common", SIDES + " select repo, n::varchar sha from (select * from ra intersect select * from rb)")
def common(spark, d):
    a, b = _sides(spark, d)
    return a.intersect(b)


@query("U3_only_left", SIDES + " select repo, n::varchar sha from (select * from ra except select * from rb)")
def only_left(spark, d):
    a, b = _sides(spark, d)
    return a.join(b, ["repo", "sha"], "left_anti")


# --- counts and reads at a ref -----------------------------------------------------------------


@query("A4_contributors", f"with {GRAPH} select repo, message || ' <' || message || '@example.org>' contributor, count(*) as commits, max(author_ts)::bigint last_ts from o group by 1, 2")
def contributors(spark, d):
    c = M.order_graph(spark, d)[0]
    return stats.contributors(c.select("repo", F.col("message").alias("author"), F.concat("message", F.lit("@example.org")).alias("author_email"), "author_ts"))


@query("A5_stats", f"with {GRAPH} select repo, count(*) as commits, count(*) filter (n % 5 = 0) as branches, count(*) filter (n % 7 = 0) as tags, count(*) filter (n % 2 = 0) as files, coalesce(sum(n) filter (n % 2 = 0), 0)::bigint as bytes from o group by repo")
def repo_stats(spark, d):
    c = M.order_graph(spark, d)[0]
    refs = c.where("n % 5 = 0").select("repo", F.concat(F.lit("refs/heads/"), "n").alias("name")).unionByName(c.where("n % 7 = 0").select("repo", F.concat(F.lit("refs/tags/"), "n").alias("name")))
    return stats.repo_stats(c, refs, c.where("n % 2 = 0").select("repo", F.col("n").alias("size")))


@query("A6_repos", "select distinct o_custkey::varchar repo from orders where o_custkey::varchar like '1%'")
def repos(spark, d):
    c = M.order_graph(spark, d)[0].withColumn("repo", F.concat(F.substring("repo", 1, 1), F.lit("/"), "repo"))
    return stats.repos(c, "1").select(F.substring_index("repo", "/", -1).alias("repo"))


@query("A2_counts", "select count(*) as objects, count(distinct " + BLOB_SHA + ") as distinct_objects from documents")
def counts(spark, d):
    return M.blobs(spark, d).agg(F.count(F.lit(1)).alias("objects"), F.countDistinct("sha").alias("distinct_objects"))


@query("R14_branches", "select o_custkey::varchar repo, 'refs/heads/' || o_orderstatus as name, max(o_orderkey)::varchar sha from orders group by 1, 2")
def branches(spark, d):
    o = M.table(spark, d, "orders")
    refs = o.groupBy(F.col("o_custkey").cast("string").alias("repo"), F.concat(F.lit("refs/heads/"), "o_orderstatus").alias("name")).agg(F.max("o_orderkey").cast("string").alias("sha"))
    tags = refs.withColumn("name", F.lit("refs/tags/x"))
    return refs.unionByName(tags).where(F.col("name").startswith("refs/heads/"))


@query("R14_tags", "select o_custkey::varchar repo, o_orderstatus as tag, max(o_orderkey)::varchar sha, o_orderstatus = 'F' annotated from orders group by 1, 2, 4")
def tags(spark, d):
    o = M.table(spark, d, "orders")
    refs = o.groupBy(F.col("o_custkey").cast("string").alias("repo"), F.concat(F.lit("refs/tags/"), "o_orderstatus").alias("name")).agg(F.max("o_orderkey").cast("string").alias("sha"))
    objects_ = o.select(F.col("o_orderkey").cast("string").alias("sha"), F.when(F.col("o_orderstatus") == "F", "tag").otherwise("commit").alias("type"))
    return refs.join(objects_, "sha").select("repo", F.substr("name", F.lit(11)).alias("tag"), "sha", (F.col("type") == "tag").alias("annotated"))


@query("R14_get_commit", "select conv_id, turn, role as author, text as message from conversations where sha1(conv_id || '/' || turn) = sha1('3/1')")
def get_commit(spark, d):
    return M.turn_commits(spark, d).where(F.col("sha") == F.sha1(F.lit("3/1"))).select(F.col("repo").alias("conv_id"), "turn", "author", "message")


@query("R14_read_file", f"select source || '/' || lang || '/' || doc_id || '.txt' path, false is_binary, text as content from documents")
def read_file(spark, d):
    b = M.blobs(spark, d)
    binary_ = C.is_binary(F.col("content"))
    return b.select("path", binary_.alias("is_binary"), F.when(binary_, F.base64("content")).otherwise(C.text_of(F.col("content"))).alias("content"))


@query("R14_list_root", f"with {FILES} select distinct r as name, '40000' as mode from f")
def list_root(spark, d):
    return M.tree_entries(spark, d).where("tree_sha = 'root'").select("name", "mode")


@query("R14_show_object", f"select {BLOB_SHA} sha, 'blob' as type, strlen(text)::bigint size, false is_binary from documents where doc_id = 5")
def show_object(spark, d):
    b = M.blobs(spark, d).where("doc_id = 5")
    return b.select("sha", F.lit("blob").alias("type"), F.octet_length("content").cast("long").alias("size"), C.is_binary(F.col("content")).alias("is_binary"))


@query("R14_grep_at_ref", f"with {FILES} select path, 1::bigint line_number, c as line from f where kept and regexp_matches(c, '#0*[0-9]?7$')")
def grep_at_ref(spark, d):
    f = M.customer_files(spark, d).where("kept")
    b = f.select("path", "sha", F.element_at(F.split("path", "/"), 3).cast("binary").alias("content"))
    return text.grep(b, "#0*[0-9]?7$", 2).select("path", "line_number", "line")


# --- codecs, packs and files: the ids of what comes back ----------------------------------------


@query("X5_zlib_roundtrip", "select doc_id, sha256(text) sha256, true used_ok from documents")
def zlib_roundtrip(spark, d):
    p = M.blobs(spark, d).select("doc_id", U.deflate("content").alias("z"))
    return p.select("doc_id", F.sha2(U.inflate("z"), 256).alias("sha256"), (U.inflate_used(F.concat("z", F.lit("rest").cast("binary"))) == F.octet_length("z")).alias("used_ok"))


@query("X7_stored_roundtrip", "select doc_id, sha256(text) sha256 from documents")
def stored_roundtrip(spark, d):
    return M.blobs(spark, d).select("doc_id", F.sha2(U.inflate(U.deflate_stored("content")), 256).alias("sha256"))


@query("X8_hash_deflate", f"select doc_id, {BLOB_SHA} sha, 'blob' as type from documents")
def hash_deflate(spark, d):
    p = M.blobs(spark, d).select("doc_id", U.loose_object(F.lit("blob"), "content").alias("o"))
    h = C.parse_header(U.inflate("o.data"))
    return p.select("doc_id", "o.sha", h["type"].alias("type"))


@query("X9_delta_roundtrip", "select a.doc_id, sha256(b.text) sha256 from documents a join documents b on b.doc_id = a.doc_id + 1")
def delta_roundtrip(spark, d):
    small_batches(spark)
    b = M.table(spark, d, "documents").select("doc_id", F.col("text").cast("binary").alias("base"))
    t = b.select((F.col("doc_id") - 1).alias("doc_id"), F.col("base").alias("target"))
    made = b.join(t, "doc_id").select("doc_id", "base", U.delta_create("base", "target").alias("delta"))
    return made.select("doc_id", F.sha2(U.delta_apply("base", "delta"), 256).alias("sha256"))


@query("S6_pack_roundtrip", f"select distinct {BLOB_SHA} sha, 'blob' as type, strlen(text)::bigint size from documents")
def pack_roundtrip(spark, d):
    stores.register(spark)
    path = scratch(spark, "packs")
    M.blobs(spark, d).select("sha", F.lit("blob").alias("type"), F.octet_length("content").cast("long").alias("size"), "content").repartition(spark.sparkContext.defaultParallelism).write.format("pack").mode("append").save(path)
    return stores.staged(spark.read.format("pack").load(path)).select("sha", "type", "size")


@query("S9_segments", "select count(*)::bigint as objects from documents")
def segments(spark, d):
    raw = M.blobs(spark, d).select(C.serialized(F.lit("blob"), F.col("content")).alias("raw"))
    return stores.segments(raw).agg(F.coalesce(F.sum("objects"), F.lit(0)).alias("objects"))


@query("S1_loose_roundtrip", f"select distinct {BLOB_SHA} sha, 'blob' as type, strlen(text)::bigint size from documents")
def loose_roundtrip(spark, d):
    path = scratch(spark, "objects")
    b = M.blobs(spark, d).select("sha", F.lit("blob").alias("type"), "content").dropDuplicates(["sha"])
    stores.write_loose(b, path).agg(F.sum("written")).first()
    return stores.read_loose(spark, f"{path}/loose", own=True).select("sha", "type", "size")


def _files_below(spark: SparkSession, folder: str) -> DataFrame:
    """(path, size, sha256) of all files below folder, read back."""
    return stores.read_files(spark, folder).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


@query("S11_worktree", f"with {FILES} select path, strlen(c)::bigint as size, sha256(encode(c)) as sha256 from f where not kept")
def worktree(spark, d):
    """Only what a second snapshot changes is written (incremental checkout)."""
    path = scratch(spark, "worktree")
    f = M.customer_files(spark, d).where("not kept")
    w = f.select("path", F.lit("blob").alias("type"), F.element_at(F.split("path", "/"), 3).cast("binary").alias("content"))
    stores.write_worktree(w, path).agg(F.sum("written")).first()
    return _files_below(spark, path)


# --- messages, refs and compositions -----------------------------------------------------------

ORDER_REFS = "select o_custkey, 'refs/heads/b' || o_orderkey as name, sha1(o_orderkey::varchar) sha from orders"


def _framed(rows: DataFrame, key: str, order: str, line) -> DataFrame:
    """(key, data): the framed lines of each key in order, then a flush."""
    one = F.array_sort(F.collect_list(F.struct(F.col(order), C.pkt_line(line).alias("l"))))
    return rows.groupBy(key).agg(F.concat(F.array_join(F.transform(one, lambda x: x["l"]), ""), F.lit("0000")).cast("binary").alias("data"))


@query("S15_refs_v1", ORDER_REFS)
def refs_v1(spark, d):
    o = M.table(spark, d, "orders")
    line = F.concat(F.sha1(F.col("o_orderkey").cast("string")), F.lit(" refs/heads/b"), "o_orderkey", F.lit("\n"))
    framed = _framed(o, "o_custkey", "o_orderkey", line)
    greeting = F.lit("001e# service=git-upload-pack\n0000").cast("binary")
    return wire.refs(framed.select("o_custkey", F.concat(greeting, "data").alias("data")), "o_custkey", "data")


@query("S16_refs_v2", ORDER_REFS)
def refs_v2(spark, d):
    o = M.table(spark, d, "orders")
    line = F.concat(F.sha1(F.col("o_orderkey").cast("string")), F.lit(" refs/heads/b"), "o_orderkey", F.lit(" symref-target:x\n"))
    return wire.refs(_framed(o, "o_custkey", "o_orderkey", line), "o_custkey", "data", 2)


@query("S18_demux", "select conv_id, coalesce(string_agg(text, '' order by turn) filter (where role = 'assistant'), '') pack, coalesce(string_agg(text, '' order by turn) filter (where role = 'user'), '') progress, coalesce(string_agg(text, '' order by turn) filter (where role = 'system'), '') errors from conversations group by 1")
def demux(spark, d):
    c = M.table(spark, d, "conversations")
    channel = F.when(F.col("role") == "assistant", "\x01").when(F.col("role") == "user", "\x02").otherwise("\x03")
    framed = _framed(c, "conv_id", "turn", F.concat(channel, "text"))
    nak = framed.select("conv_id", F.concat(F.lit("0008NAK\n").cast("binary"), "data").alias("data"))
    return wire.fetched(nak, "conv_id", "data").select("conv_id", F.col("pack").cast("string").alias("pack"), "progress", "errors")


@query("S19_push_reports", "select o_custkey, true as unpacked, 'refs/heads/b' || o_orderkey as ref, o_orderkey % 3 <> 0 as ok, case when o_orderkey % 3 = 0 then 'stale ' || o_orderkey end as error from orders")
def push_reports(spark, d):
    o = M.table(spark, d, "orders")
    k = F.col("o_orderkey")
    line = F.when(k % 3 == 0, F.concat(F.lit("ng refs/heads/b"), k, F.lit(" stale "), k)).otherwise(F.concat(F.lit("ok refs/heads/b"), k))
    framed = _framed(o, "o_custkey", "o_orderkey", F.concat(line, F.lit("\n")))
    return wire.push_reports(framed.select("o_custkey", F.concat(F.lit("000eunpack ok\n").cast("binary"), "data").alias("data")), "o_custkey", "data")


@query("S20_pkt_decode", "select o_custkey, row_number() over (partition by o_custkey order by o_orderkey) - 1 as ord, o_orderpriority as line from orders")
def pkt_decode(spark, d):
    framed = _framed(M.table(spark, d, "orders"), "o_custkey", "o_orderkey", F.col("o_orderpriority"))
    return wire.lines(framed, "o_custkey", "data").select("o_custkey", "ord", F.col("line").cast("string").alias("line"))


REF_UPDATES = """
r as (select o_custkey::varchar repo, 'refs/heads/' || o_orderstatus as name, sha1(max(o_orderkey)::varchar) sha from orders group by 1, 2),
u as (select repo, name, case when repo::int % 3 = 0 then sha1('other') else sha end old_sha, case when repo::int % 4 = 0 then repeat('0', 40) else sha1(sha) end new_sha from r where repo::int % 5 <> 0)"""


def _ref_updates(spark, d):
    o = M.table(spark, d, "orders")
    r = o.groupBy(F.col("o_custkey").cast("string").alias("repo"), F.concat(F.lit("refs/heads/"), "o_orderstatus").alias("name")).agg(F.sha1(F.max("o_orderkey").cast("string")).alias("sha"))
    k = F.col("repo").cast("int")
    u = r.where(k % 5 != 0).select("repo", "name", F.when(k % 3 == 0, F.sha1(F.lit("other"))).otherwise(F.col("sha")).alias("old_sha"), F.when(k % 4 == 0, "0" * 40).otherwise(F.sha1("sha")).alias("new_sha"))
    return refs.update(r, u)


@query("S19_ref_updates", f"with {REF_UPDATES} select u.repo, u.name, r.sha = u.old_sha as ok, case when r.sha <> u.old_sha then 'stale info' end as error from u join r using (repo, name)")
def ref_updates(spark, d):
    return _ref_updates(spark, d)[1]


@query("R14_refs_after_updates", f"with {REF_UPDATES} select r.repo, r.name, case when r.sha = u.old_sha then u.new_sha else r.sha end sha from r left join u on u.repo = r.repo and u.name = r.name where u.repo is null or r.sha <> u.old_sha or u.new_sha <> repeat('0', 40)")
def refs_after(spark, d):
    return _ref_updates(spark, d)[0]


def _snapshots(spark, d):
    f, k = M.customer_files(spark, d), F.col("c_custkey")
    head = f.where(k % 7 != 0).select("path", F.when(k % 4 == 0, F.sha1("sha")).otherwise(F.col("sha")).alias("sha"))
    commit = f.where(k % 11 != 0).select("path", F.when(k % 6 == 0, F.sha2("sha", 256)).otherwise(F.col("sha")).alias("sha"))
    return f.select("path", "sha"), commit, head


PICK = f"with {FILES}, p as (select path, sha from f), o as (select path, case when c_custkey % 4 = 0 then sha1(sha) else sha end sha from f where c_custkey % 7 <> 0), c as (select path, case when c_custkey % 6 = 0 then sha256(sha) else sha end sha from f where c_custkey % 11 <> 0), x as (select coalesce(b.path, o.path, t.path) path, b.sha b, o.sha o, t.sha t from {{b}} b full join o on o.path = b.path full join {{t}} t on t.path = coalesce(b.path, o.path)) select path, case when t is not distinct from b then o else t end sha, (o is distinct from b and t is distinct from b and o is distinct from t) as conflict from x where case when t is not distinct from b then o else t end is not null or (o is distinct from b and t is distinct from b and o is distinct from t)"


@query("R14_cherry_pick", PICK.format(b="p", t="c"))
def cherry_pick(spark, d):
    before, commit, head = _snapshots(spark, d)
    return trees.cherry_pick(before, commit, head, ["path"])


@query("R14_revert", PICK.format(b="c", t="p"))
def revert(spark, d):
    before, commit, head = _snapshots(spark, d)
    return trees.revert(before, commit, head, ["path"])


@query("R14_diff_refs", f"with {FILES} select path, 'modified' as status, false is_binary, strlen(c)::bigint old_size, strlen(c)::bigint + 4 new_size, '--- a/' || path || chr(10) || '+++ b/' || path || chr(10) || '@@ -1,1 +1,1 @@' || chr(10) || '-' || c || chr(10) || '+' || c || ' new' || chr(10) as patch from f where c_custkey % 10 = 0")
def diff_refs(spark, d):
    f, k = M.customer_files(spark, d), F.col("c_custkey")
    name = F.element_at(F.split("path", "/"), 3)
    content = F.when(k % 10 == 0, F.concat(name, F.lit(" new"))).otherwise(name).cast("binary")
    new = f.select("path", C.object_id("blob", content).alias("sha"), content.alias("content"))
    blobs = new.select("sha", "content").unionByName(f.select("sha", name.cast("binary").alias("content"))).dropDuplicates(["sha"])
    return trees.diff(f.select("path", "sha"), new.select("path", "sha"), blobs)


@query("S12_checkout", f"with {FILES} select path, strlen(c)::bigint as size, sha256(encode(c)) as sha256 from f")
def checkout(spark, d):
    path = scratch(spark, "checkout")
    f = M.customer_files(spark, d)
    blobs = f.select("sha", F.element_at(F.split("path", "/"), 3).cast("binary").alias("content")).dropDuplicates(["sha"])
    roots = spark.range(1).select(F.lit("all").alias("root"), F.lit("root").alias("tree_sha"))
    stores.write_worktree(trees.checkout(M.tree_entries(spark, d), roots, blobs), path).agg(F.sum("written")).first()
    return _files_below(spark, path)


@query("L5_revwalk", LOG + " select repo, n::varchar sha, row_number() over (partition by repo order by n desc) - 1 as pos from w")
def revwalk(spark, d):
    """Times grow with n here, so children come before parents by n alone."""
    commits, parents = M.order_graph(spark, d)
    return history.revwalk(parents, commits.select("repo", "sha", F.col("n").alias("author_ts")), _heads(commits).select("repo", "sha"))
