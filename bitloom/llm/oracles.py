"""SQL for DuckDB, from the definitions of the contracts, of those operators whose results SQL can express."""

from __future__ import annotations

from .quality import DELTA, GRID, RATE

#: Every 50-byte string of a text with its place; those that a smaller document holds; runs of them; what lies between.
OP10_SUFFIX_DEDUP = """
with texts as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
chunks as (select doc_id, k, substr(h, 2000 * k + 1, 2098) as h from (select doc_id, h, unnest(range(0, length(h) // 2000 + 1)) as k from texts)),
strings as (select doc_id, 1000 * k + s as s, substr(h, 2 * s + 1, 100) as g from (select doc_id, k, h, unnest(range(0, least(1000, length(h) // 2 - 49))) as s from chunks)),
firsts as (select g, min(doc_id) as f from strings group by g),
repeats as (select doc_id, s from strings join firsts using (g) where doc_id > f),
marked as (select doc_id, s, case when s <= lag(s) over (partition by doc_id order by s) + 50 then 0 else 1 end as opens from repeats),
numbered as (select doc_id, s, sum(opens) over (partition by doc_id order by s) as run from marked),
spans as (select doc_id, min(s) as b, max(s) + 50 as e from numbered group by doc_id, run),
gaps as (
    select doc_id, coalesce(lag(e) over (partition by doc_id order by b), 0) as b, b as e from spans
    union all select doc_id, max(e), null from spans group by doc_id
),
kept as (
    select t.doc_id, string_agg(substr(h, 2 * b + 1, 2 * (coalesce(e, length(h) // 2) - b)), '' order by b) as k
    from texts t join gaps g on t.doc_id = g.doc_id group by t.doc_id
),
counts as (select doc_id, sum(e - b) as n_removed, count(*) as n_spans from spans group by doc_id)
select t.doc_id, cast(length(h) // 2 as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, cast(coalesce(n_spans, 0) as bigint) as n_spans,
    sha256(unhex(coalesce(k, h))) as kept_sha256
from texts t left join counts c on t.doc_id = c.doc_id left join kept k on t.doc_id = k.doc_id
"""

#: All links: distinct texts of a weighted Jaccard similarity of 0.8 or more over their TF-IDF shingles.
NEAR_LINKS = """
texts as (select coalesce(text, '') as text, min(doc_id) as node from documents group by coalesce(text, '')),
words as (select node, list_filter(string_split_regex(lower(text), '[\\x09-\\x0D ]+'), lambda x: x <> '') as w from texts),
cut as (select node, unnest(case when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as g from words where len(w) > 0),
tf as (select node, g, count(*) as n from cut group by node, g),
df as (select g, count(*) as d from tf group by g),
weighted as (select node, g, (1 + ln(n)) * (1 + ln((1.0 + (select count(*) from texts)) / (1 + d))) as w from tf join df using (g)),
totals as (select node, sum(w) as t from weighted group by node),
commons as (select a.node as a, b.node as b, sum(least(a.w, b.w)) as c from weighted a join weighted b on a.g = b.g and a.node > b.node group by a.node, b.node),
links as (select a, b from commons join totals x on x.node = a join totals y on y.node = b where c >= 0.8 * (x.t + y.t - c) - 1e-9)
"""
#: Components of all links, and what holds for equal texts.
OP7_NEAR_DEDUP = f"""
with recursive {NEAR_LINKS},
ways as (select a, b from links union select b, a from links),
reach(a, b) as (select a, a from ways union select r.a, w.b from reach r join ways w on r.b = w.a),
classes as (select a, min(b) as class_id from reach group by a)
select d.doc_id, coalesce(class_id, node) as class_id from documents d join texts t on coalesce(d.text, '') = t.text left join classes on a = node
"""

#: Parts of the text, the edited text and the next text as 60-bit digests; cells by their bits; likeness by sets.
OP4_FINGERPRINTS = r"""
with next_texts as (
    select doc_id, coalesce(text, '') as text, coalesce(lead(coalesce(text, '')) over (order by doc_id desc), first_value(coalesce(text, '')) over (order by doc_id desc rows between unbounded preceding and unbounded following)) as next_text
    from documents
),
edits as (select doc_id, text, next_text, substr(text, 1, length(text) - length(text) // 2) || substr(next_text, 1, length(text) // 2) as edited from next_texts),
versions as (select doc_id, 't' as v, text as x from edits union all select doc_id, 'e', edited from edits union all select doc_id, 'n', next_text from edits),
lines as (select doc_id, v, unnest(string_split(x, chr(10))) as x from versions),
parts as (select doc_id, v, unnest(case when length(x) > 200 then string_split(regexp_replace(x, '([.!?]|[^ \n]{12}) +', '\1' || chr(10), 'g'), chr(10)) else [x] end) as part from lines),
digests as (select distinct doc_id, v, cast('0x' || substr(md5(part), 1, 15) as bigint) as k from parts where trim(part) <> ''),
thirds as (select doc_id, v, k, unnest([0, 1, 2]) as j from digests),
placed as (select doc_id, v, k, (k >> (20 * j)) % 48 + 48 * j as pos from thirds),
cells as (select doc_id, v, pos, count(*) as c, bit_xor(k) as k from placed group by doc_id, v, pos),
prints as (select doc_id, v, string_agg(hex(pos) || '.' || cast(c as varchar) || '.' || hex(k), ' ' order by pos) as p from cells group by doc_id, v),
sizes as (select doc_id, v, count(*) as n from digests group by doc_id, v),
shared as (select a.doc_id, b.v, count(*) as n from digests a join digests b on a.doc_id = b.doc_id and a.k = b.k where a.v = 't' and b.v <> 't' group by a.doc_id, b.v),
near as (
    select e.doc_id, w.v, case when coalesce(a.n, 0) + coalesce(b.n, 0) = 0 then 1.0 else 1.0 * (2 * coalesce(s.n, 0)) / (2 * (coalesce(a.n, 0) + coalesce(b.n, 0) - coalesce(s.n, 0))) end as y
    from edits e cross join (select unnest(['e', 'n']) as v) w left join sizes a on a.doc_id = e.doc_id and a.v = 't' left join sizes b on b.doc_id = e.doc_id and b.v = w.v
        left join shared s on s.doc_id = e.doc_id and s.v = w.v
)
select e.doc_id, cast(length(e.text) as bigint) as n_chars, sha256(e.edited) as edited_sha256, coalesce(pt.p, '') as fingerprint, coalesce(pe.p, '') as edited_fingerprint,
    cast(ne.y as double) as near_edited, cast(nn.y as double) as near_next
from edits e left join prints pt on pt.doc_id = e.doc_id and pt.v = 't' left join prints pe on pe.doc_id = e.doc_id and pe.v = 'e'
    join near ne on ne.doc_id = e.doc_id and ne.v = 'e' join near nn on nn.doc_id = e.doc_id and nn.v = 'n'
"""
#: CRC-32 by its table, which follows from the polynomial; shards by the largest of 52-bit draws, all weights being equal.
OP8_SHARDING = """
with recursive steps(n, i, c) as (
    select n, 0, n from (select unnest(range(256)) as n)
    union all select n, i + 1, case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end from steps where i < 8
),
crc as (select list(c order by n) as t from steps where i = 8),
hexed as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
summed as (
    select doc_id, 16 + length(h) // 2 as size,
        xor(4294967295, list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(range(length(h) // 2), lambda i: cast('0x' || substr(h, 2 * i + 1, 2) as bigint))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) as text_crc32
    from hexed cross join crc
),
drawn as (select doc_id, s, cast('0x' || substr(md5(concat_ws(':', cast(doc_id as varchar), cast(s as varchar))), 1, 13) as bigint) as u from documents cross join (select unnest(range(41)) as s)),
best as (select doc_id, arg_max(s, {'u': u, 's': -s}) filter (s < 40) as shard, arg_max(s, {'u': u, 's': -s}) as grown from drawn group by doc_id),
placed as (select *, cast('0x' || substr(md5(concat_ws(':', cast(doc_id as varchar), cast(size as varchar), cast(text_crc32 as varchar))), 1, 13) as bigint) >> 36 as place from summed join best using (doc_id))
select doc_id, cast(size as bigint) as size, cast(text_crc32 as bigint) as text_crc32, 'key' as law, cast(shard as int) as shard,
    cast(row_number() over (partition by shard order by place, doc_id, size, text_crc32) - 1 as bigint) as slot, cast(grown as int) as grown_shard
from placed
"""
_LADDER = {m: "[" + ", ".join(f"cast({c} as double)" for c in cuts) + "]" for m, cuts in GRID.items()}
_REJECTS = " or ".join(f"{m} > {cuts}[i]" for m, cuts in _LADDER.items())
#: Counts of words, symbols, lines and windows; binomial tails by the gamma function; the last step before one fails.
OP9_QUALITY_RULES = rf"""
with texts as (select doc_id, coalesce(lang, '') as stratum, coalesce(text, '') as t from documents),
words as (select doc_id, stratum, t, list_filter(string_split_regex(t, '[\x09-\x0D ]+'), lambda x: x <> '') as w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x09-\x0D ]')) as l from texts),
windows as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from (select doc_id, w, unnest(range(1, greatest(1, len(w) - 1))) as i from words)),
again as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as n from windows) where n > 1),
repeated as (select doc_id, count(distinct p) as n from (select doc_id, unnest([i, i + 1, i + 2]) as p from again) group by doc_id),
counts as (
    select doc_id, stratum, len(w) as n_words, length(regexp_replace(t, '[\x09-\x0D ]', '', 'g')) as word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as n_symbols,
        len(l) - len(list_distinct(l)) as n_dup_lines, coalesce(n, 0) as n_repeat_words, len(l) as n_lines, length(regexp_replace(t, '[^\p{{Lu}}]', '', 'g')) as n_upper
    from words left join repeated using (doc_id)
),
features as (
    select *, case when word_chars > 0 then n_symbols / word_chars else 0 end as symbol_ratio, case when n_lines > 0 then n_dup_lines / n_lines else 0 end as dup_line_ratio,
        case when n_words > 0 then n_repeat_words / n_words else 0 end as repeat_ratio, case when word_chars > 0 then n_upper / word_chars else 0 end as upper_ratio,
        n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed
    from counts
),
good as (select f.* from features f where not base_failed and doc_id in (select doc_id from labels where quality = 1)),
tests as (select stratum, i, count(*) as n, count_if({_REJECTS}) as k from good cross join (select unnest(range(1, {len(next(iter(GRID.values()))) + 1})) as i) group by stratum, i),
tails as (
    select stratum, i, case when k > n * {RATE} then 1.0 else (select sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({RATE}) + (n - j) * ln(1 - {RATE}))) from (select unnest(range(cast(k as bigint) + 1)) as j)) end as p from tests
),
steps as (select stratum, coalesce(min(i) filter (p > {DELTA} / (select count(distinct stratum) from tests)), {len(next(iter(GRID.values()))) + 1}) - 1 as i from tails group by stratum),
judged as (select f.*, coalesce(i, 0) as i from features f left join steps using (stratum))
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols, cast(n_dup_lines as bigint) as n_dup_lines,
    cast(n_repeat_words as bigint) as n_repeat_words, base_failed, not base_failed and not (i > 0 and ({_REJECTS})) as kept, stratum, {", ".join(f"cast({m} as double) as {m}" for m in GRID)}
from judged
"""

#: Words one edit apart share what is left when one letter is taken from the longer, or from the same place of both.
OP11_SPELLING_VARIANTS = r"""
with recursive steps(n, i, c) as (
    select n, 0, n from (select unnest(range(256)) as n)
    union all select n, i + 1, case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end from steps where i < 8
),
crc as (select list(c order by n) as t from steps where i = 8),
found as (select coalesce(cast(doc_id as varchar), '') as d, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) as r from documents),
runs as (select d, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as r, count(*) as n from found where length(r) >= 5 group by all),
hexed as (select *, hex(encode(d || ':' || r)) as x from runs),
summed as (
    select r, n, xor(4294967295, list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(range(length(x) // 2), lambda i: cast('0x' || substr(x, 2 * i + 1, 2) as bigint))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) as h
    from hexed cross join crc
),
edited as (select case when h % 97 = 0 then substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) else r end as word, n from summed),
words as (select word, cast(sum(n) as bigint) as n from edited where length(word) >= 5 group by word having sum(n) >= 3),
cut as (select word, n, i, substr(word, 1, i) || substr(word, i + 2) as rest from (select *, unnest(range(length(word))) as i from words)),
near as (
    select a.word, b.word as v, b.n as m from cut a join cut b on a.rest = b.rest and a.i = b.i and a.word <> b.word
    union select a.word, b.word, b.n from cut a join words b on a.rest = b.word
    union select b.word, a.word, a.n from cut a join words b on a.rest = b.word
),
best as (select word, count(*) as n_near, max(m) as m from near group by word),
forms as (select b.word, n_near, min(v) as form, b.m from best b join near x on b.word = x.word and b.m = x.m group by b.word, n_near, b.m),
known as (select w.word, w.n, coalesce(n_near, 0) as n_near, case when m >= 2 * n then form end as form, case when m >= 2 * n then m end as form_n from words w left join forms f on w.word = f.word),
walk(word, here, k) as (select word, word, 0 from known union all select w.word, x.form, k + 1 from walk w join known x on w.here = x.word where x.form is not null),
roots as (select word, arg_max(here, k) as root from walk group by word)
select k.word, form, root, k.n, cast(n_near as bigint) as n_near, form_n from known k join roots r on k.word = r.word
"""

#: Words with their piece and place; phrases by joining words that follow one another; products of 128 bits.
OP12_COLLOCATIONS = r"""
with texts as (select row_number() over () as id, coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
pieces as (select id, lang, unnest(p) as p, unnest(range(len(p))) as k from (select id, lang, string_split_regex(t, '[.,;:!?\x0A-\x0D]') as p from texts)),
words as (select id, k, lang, unnest(w) as w, unnest(range(len(w))) as i from (select id, k, lang, list_filter(string_split_regex(p, '[ \t]+'), lambda x: x <> '') as w from pieces)),
trios as (select lang, w, lead(w) over o as w2, lead(w, 2) over o as w3 from words window o as (partition by id, k order by i)),
one as (select lang, w as phrase, count(*) as f from trios group by lang, w),
two as (select lang, w, w2, w || ' ' || w2 as phrase, count(*) as f from trios where w2 is not null group by lang, w, w2 having count(*) >= 10),
three as (select lang, w, w2, w3, w || ' ' || w2 || ' ' || w3 as phrase, count(*) as f from trios where w3 is not null group by lang, w, w2, w3 having count(*) >= 10),
longest as (select lang, phrase, max(f) as f from (select lang, w || ' ' || w2 as phrase, f from three union all select lang, w2 || ' ' || w3, f from three) group by lang, phrase),
cuts as (
    select c.lang, c.phrase, c.f as a, 1 as k, x.f as l, y.f as r from two c join one x on x.lang = c.lang and x.phrase = c.w join one y on y.lang = c.lang and y.phrase = c.w2
        left join longest z on z.lang = c.lang and z.phrase = c.phrase where z.f is null or 100 * z.f < 50 * c.f
    union all select c.lang, c.phrase, c.f, 1, x.f, y.f from three c join one x on x.lang = c.lang and x.phrase = c.w join two y on y.lang = c.lang and y.w = c.w2 and y.w2 = c.w3
    union all select c.lang, c.phrase, c.f, 2, x.f, y.f from three c join two x on x.lang = c.lang and x.w = c.w and x.w2 = c.w2 join one y on y.lang = c.lang and y.phrase = c.w3
),
scored as (select *, cast(1000000 as hugeint) * a * a // (cast(l as hugeint) * r) as score from cuts),
lowest as (select *, row_number() over (partition by lang, phrase order by score, k) as p from scored),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from lowest where p = 1),
totals as (select lang, sum(f) as n from one group by lang)
select q.lang, cast(rank as bigint) as rank, phrase, cast(a as bigint) as a, cast(l as bigint) as l, cast(r as bigint) as r, cast(n as bigint) as n, cast(score as bigint) as score
from ranked q join totals t on q.lang = t.lang where rank <= 2000
"""

ORACLES: dict[str, str] = {"op4_fingerprints": OP4_FINGERPRINTS, "op7_near_dedup": OP7_NEAR_DEDUP, "op8_sharding": OP8_SHARDING, "op9_quality_rules": OP9_QUALITY_RULES, "op10_suffix_dedup": OP10_SUFFIX_DEDUP, "op11_spelling_variants": OP11_SPELLING_VARIANTS, "op12_collocations": OP12_COLLOCATIONS}
