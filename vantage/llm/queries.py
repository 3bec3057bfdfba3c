"""The registered queries of the operators in this package, and their SQL where it can be written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False).drop("ids")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination_digest, find_contamination

    return contamination_digest(find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import fit, held_out, predict

    docs = table(spark, sf_dir, "documents")
    model = fit(docs.filter(~held_out()))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "cost", "rejected")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import dedup_substrings

    return dedup_substrings(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"), F.sha2("text", 256).alias("kept_sha256"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .shared import Written, new_folder, remove
    from .warc import capture_histories, capture_index, read_archives, write_archives

    folder = new_folder(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), folder)
    kept = Written(spark, "captures")
    entries = kept.put("entries", read_archives(spark, folder))
    remove(spark, folder)
    index = kept.put("index", capture_index(entries))
    kept.drop("entries")
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", F.unix_seconds("captured_at").alias("captured_s"), "place", "capture_no")
    return capture_histories(index).select(*columns)


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat_format import format_preferences, next_replies

    return format_preferences(*next_replies(table(spark, sf_dir, "conversations")))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), width=4).select("doc_id", "n_shingles", "component_id", "kept")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .collocations import collocations

    return collocations(table(spark, sf_dir, "documents"))


def op12_sentencepieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .sentencepieces import decode, encode

    model = public_tokenizers.path("piece_bpe_32k.model")
    both = decode(encode(table(spark, sf_dir, "documents"), model), model)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return both.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .resampling import resample

    drawn = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_nearest": op2_nearest,
    "op3_packing": op3_packing,
    "op4_line_dedup": op4_line_dedup,
    "op5_warc": op5_warc,
    "op6_decontamination": op6_decontamination,
    "op7_license_scan": op7_license_scan,
    "op8_chat_format": op8_chat_format,
    "op9_language_id": op9_language_id,
    "op10_near_duplicates": op10_near_duplicates,
    "op11_collocations": op11_collocations,
    "op12_sentencepieces": op12_sentencepieces,
    "op13_resampling": op13_resampling,
    "pipeline": pipeline,
}

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANK = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": f"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), {_BLANK}) as w from documents),
p as (select doc_id, w, unnest(range(1, len(w) + 1)) as i from d),
x as (select doc_id, i, w[i] as word, case when i + 19 <= len(w) then array_to_string(w[i:i + 19], ' ') end as win from p),
f as (select *, case when win is null then 0 when first_value(doc_id) over k = doc_id and first_value(i) over k = i then 0 else 1 end as late
      from x window k as (partition by win order by doc_id, i)),
g as (select *, max(late) over (partition by doc_id order by i rows between 19 preceding and current row) as gone from f),
s as (select doc_id, sum(gone) as n_removed, string_agg(word, ' ' order by i) filter (gone = 0) as kept from g group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_removed, 0) as bigint) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from d left join s using (doc_id)""",
    "op4_line_dedup": rf"""
with d as (select doc_id, string_split(text, chr(10)) as lines from documents where text is not null),
l as (select doc_id, i, lines[i] as line, len(regexp_extract_all(lines[i], {_BLANK})) as n_words from (select *, unnest(range(1, len(lines) + 1)) as i from d)),
w as (select doc_id, i, n, array_to_string(lines[i:i + n - 1], chr(10)) as run
      from (select *, unnest(range(1, len(lines) - i + 2)) as n from (select *, unnest(range(1, len(lines) + 1)) as i from d))),
f as (select doc_id, i, n, row_number() over (partition by n, run order by doc_id, i) > 1 as late from w),
r as (select doc_id, i, max(n) as n from f where late group by doc_id, i),
k as (select r.doc_id, r.i, r.n from r join l on l.doc_id = r.doc_id and l.i >= r.i and l.i < r.i + r.n
      group by r.doc_id, r.i, r.n having count(*) filter (n_words > 0) >= 2 or sum(n_words) >= 50),
g as (select distinct doc_id, unnest(range(i, i + n)) as i from k),
s as (select l.*, g.i is not null as gone from l left join g using (doc_id, i))
select documents.doc_id, count(s.i) as n_lines, count(*) filter (gone) as n_removed,
  case when any_value(text) is not null then sha256(coalesce(string_agg(line, chr(10) order by s.i) filter (not gone), '')) end as kept_sha256
from documents left join s using (doc_id) group by documents.doc_id""",
    "op5_warc": """
with d as (select page_id, coalesce(html, '') as body, regexp_extract(coalesce(url, ''), '^[a-zA-Z]+://([^/:?#]*)(?::[0-9]*)?([^?#]*)([?][^#]*)?', ['host', 'path', 'query']) as u from pages),
k as (select page_id, body, lower(array_to_string(list_reverse(string_split(regexp_replace(lower(u.host), '^www[.]', ''), '.')), ',') || ')' || case when u.path = '' then '/' else u.path end || u.query) as url_key from d),
e as (select page_id, url_key, 1577836800 + page_id % 1500000000 as captured_s, strlen(body) as n, sha1(body) as h, min(page_id) over (partition by body) as first from k)
select page_id, n as payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 1 + 5 * (k // 4), 5))::bigint >> (15 - 5 * (k % 4))) & 31), 1)), 'string_agg', '') as payload_digest,
  case when first = page_id then 'response' else 'revisit' end as record_type, case when first <> page_id then first end as refers_to,
  url_key, captured_s, row_number() over (order by url_key, captured_s, page_id) - 1 as place, row_number() over (partition by url_key order by captured_s, page_id) as capture_no
from e""",
    "op6_decontamination": f"""
with d as (select doc_id, regexp_extract_all(coalesce({_LOWER}, ''), {_ALNUM}) as w from documents),
b as (select item_id, regexp_extract_all(coalesce({_LOWER}, ''), {_ALNUM}) as w from benchmark),
bw as (select distinct item_id, len(win) as n, array_to_string(win, ' ') as win from
       (select item_id, w[i:i + least(10, len(w)) - 1] as win from (select item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from b where len(w) > 0))),
sizes as (select distinct n from bw),
dw as (select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') as win from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, sizes where len(w) >= n)),
hits as (select doc_id, i, dw.n, item_id from dw join bw using (n, win)),
spots as (select doc_id, count(distinct j) as n_hit from (select doc_id, unnest(range(i, i + n)) as j from hits) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as list from (select distinct doc_id, cast(item_id as varchar) as item from hits) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(list, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join spots using (doc_id) left join items using (doc_id)""",
    "op8_chat_format": """
with t as (select distinct conv_id, turn, role, text from conversations where conv_id is not null and turn is not null),
k as (select conv_id, max(turn) as last from t where role = 'assistant' group by conv_id),
o as (select conv_id, last, row_number() over (order by conv_id) as at, count(*) over () as n from k),
p as (select o.conv_id, o.last, q.conv_id as giver, q.last as given from o join o as q on q.at = o.at % o.n + 1 where q.conv_id <> o.conv_id),
c as (select conv_id, turn, role, text from t join p using (conv_id) where turn <= last),
j as (select conv_id, turn, role, text from t join p using (conv_id) where turn < last
      union select p.conv_id, p.last, t.role, t.text from p join t on t.conv_id = giver and t.turn = given and t.role = 'assistant'),
s as (select 'chosen' as side, * from c union all select 'rejected', * from j),
x as (select *, '<|' || coalesce(role, 'unknown') || '|>' || chr(10) as head, coalesce(text, '') as said from s),
ct as (select conv_id, turn, string_agg(head || said, chr(10) order by role, text) as v from x where side = 'chosen' group by all),
rt as (select conv_id, turn, string_agg(head || said, chr(10) order by role, text) as v from x where side = 'rejected' group by all),
cut as (select conv_id, min(case when ct.v is distinct from rt.v then turn end) as split from ct full join rt using (conv_id, turn) group by conv_id),
y as (select x.*, case when split is null or turn < split then 'prompt' else side end as part from x join cut using (conv_id) where side = 'chosen' or turn >= split),
z as (select *, coalesce(sum(length(head) + length(said) + 1) over (partition by conv_id, part order by turn, role, text rows between unbounded preceding and 1 preceding), 0) + length(head) as spot from y)
select conv_id as pair_id, count(distinct case when part = 'prompt' then turn end) as n_prompt_turns,
  coalesce(string_agg(head || said || chr(10), '' order by turn, role, text) filter (part = 'prompt'), '') as prompt,
  coalesce(string_agg(head || said || chr(10), '' order by turn, role, text) filter (part = 'chosen'), '') as chosen,
  coalesce(string_agg(head || said || chr(10), '' order by turn, role, text) filter (part = 'rejected'), '') as rejected,
  coalesce(string_agg(cast(spot as bigint) || '-' || cast(spot + length(said) as bigint), ',' order by turn, role, text) filter (part = 'chosen' and role = 'assistant'), '') as chosen_mask,
  coalesce(string_agg(cast(spot as bigint) || '-' || cast(spot + length(said) as bigint), ',' order by turn, role, text) filter (part = 'rejected' and role = 'assistant'), '') as rejected_mask
from z group by conv_id""",
    "op10_near_duplicates": f"""
with recursive d as (select doc_id, regexp_extract_all(coalesce({_LOWER}, ''), {_BLANK}) as w from documents),
g as (select doc_id, unnest(list_distinct(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
      else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end)) as s from d),
n as (select doc_id, count(*) as n_shingles from g group by doc_id),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as shared from g a join g b on a.s = b.s and a.doc_id <> b.doc_id group by all),
links as (select a, b from pairs join n x on x.doc_id = a join n y on y.doc_id = b where 100 * shared >= 80 * (x.n_shingles + y.n_shingles - shared)),
reach as (select doc_id, doc_id as low from d union select links.a, reach.low from reach join links on links.b = reach.doc_id)
select d.doc_id, coalesce(n_shingles, 0) as n_shingles, c.low as component_id, d.doc_id = c.low as kept
from d left join n using (doc_id) join (select doc_id, min(low) as low from reach group by doc_id) c using (doc_id)""",
    "op11_collocations": rf"""
with p as (select coalesce(lang, 'und') as lang, regexp_extract_all(unnest(string_split_regex(coalesce({_LOWER}, ''), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') as w from documents),
n as (select lang, cast(sum(len(w)) as bigint) as n from p group by lang),
g as (select lang, m, array_to_string(w[i:i + m - 1], ' ') as phrase from (select lang, w, m, unnest(range(1, len(w) - m + 2)) as i from p, (values (1), (2), (3)) as sizes(m) where len(w) >= m)),
f as (select lang, m, phrase, count(*) as f from g group by all having count(*) >= 10),
c as (select *, array_to_string(w[:k], ' ') as head, array_to_string(w[k + 1:], ' ') as rest from (select lang, m, phrase, f as a, string_split(phrase, ' ') as w, unnest(range(1, m)) as k from f where m > 1)),
s as (select c.*, x.f as l, y.f as r, cast((cast(a as hugeint) * a * 1000000) // (cast(x.f as hugeint) * y.f) as bigint) as score
      from c join f x on x.lang = c.lang and x.phrase = head join f y on y.lang = c.lang and y.phrase = rest),
b as (select *, row_number() over (partition by lang, phrase order by score, k) as cut from s),
i as (select lang, f, array_to_string(w[j:j + 1], ' ') as phrase from (select lang, f, string_split(phrase, ' ') as w, unnest([1, 2]) as j from f where m = 3)),
o as (select lang, phrase, max(f) as most from i group by all),
v as (select b.*, row_number() over (partition by b.lang order by score desc, a desc, phrase) as rank from b left join o using (lang, phrase) where cut = 1 and not coalesce(100 * most >= 50 * a, false))
select lang, rank, phrase, a, l, r, n, score from v join n using (lang) where rank <= 2000""",
    "op13_resampling": f"""
with tab as (select list(list_reduce(list_prepend(cast(i as bigint), range(0, 8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as t from (select unnest(range(0, 256)) as i)),
d as (select row_number() over () as id, doc_id, regexp_extract_all(coalesce({_LOWER}, ''), {_ALNUM}) as w from documents),
q as (select regexp_extract_all(coalesce({_LOWER}, ''), {_ALNUM}) as w from benchmark),
x as (select id, unnest(w) as word from d),
y as (select unnest(w) as word from q),
v as (select distinct word from (select word from x union all select word from y)),
h as (select word, xor(list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(range(0, strlen(word)), lambda i: cast('0x' || substr(hex(word), 2 * i + 1, 2) as bigint))), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) % 10000 as bucket from v, tab),
s as (select bucket, count(*) as s from x join h using (word) group by bucket),
t as (select bucket, count(*) as t from y join h using (word) group by bucket),
n as (select (select count(*) from x) as s_all, (select count(*) from y) as t_all),
g as (select bucket, cast(floor(1000 * ln((coalesce(t, 0) + 1)::double * (s_all + 10000) / ((coalesce(s, 0) + 1)::double * (t_all + 10000)))) as bigint) as gain from s full join t using (bucket), n),
e as (select id, cast(sum(gain) as bigint) as weight from x join h using (word) join g using (bucket) group by id),
z as (select d.id, doc_id, cast(len(w) as bigint) as n_features, coalesce(weight, 0) as weight, cast('0x' || substr(sha256('2024:' || doc_id), 1, 8) as bigint) as h from d left join e using (id)),
k as (select *, weight + cast(floor(-1000 * ln(-ln((h + 0.5) / 4294967296::double))) as bigint) as score from z),
r as (select *, row_number() over (partition by n_features >= 20 order by score desc, doc_id) as place, count(*) filter (n_features >= 20) over () as able from k)
select doc_id, n_features, weight, score, case when n_features >= 20 and place <= 10 * able // 100 then place end as rank from r""",
}
