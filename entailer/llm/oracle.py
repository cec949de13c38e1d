"""DuckDB SQL for the queries of :mod:`entailer.llm.queries` that SQL can express."""

from __future__ import annotations

from entailer.llm import chat, licenses, repetition, substrings, urls


def op3() -> str:
    esc = lambda c: (f"replace(replace(replace({c}, '\\', '\\b'), '<', '\\l'), '#', '\\h')")
    text = "\\### Assistant: </turn> ok"
    return f"""
with rows as (
  select conv_id, turn, coalesce(role, '') r, coalesce(text, '') t from conversations
  union all select -7, 0, 'user', '{text}' union all select -7, 1, 'assistant', '{text}'),
marked as (
  select *, lag(r) over w as prev, row_number() over w as k from rows
  window w as (partition by conv_id order by turn nulls first, r, t))
select conv_id, count(*) as n_turns,
  sha256(string_agg(r || chr(10) || t || chr(10), '' order by k)) as turns_sha256,
  coalesce(sum(length(t)) filter (r = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(t, '' order by k) filter (r = 'assistant'), '')) as loss_sha256,
  sum(length({esc('t')}) + case when prev is null or prev <> r
      then length({esc('r')}) + {len(chat.OPEN) + len(chat.HEAD_END) + len(chat.CLOSE)}
      else {len(chat.PART)} end)::bigint as formatted_chars
from marked group by conv_id"""


def op4() -> str:
    values, n = [], 0
    for tid, (text, label) in enumerate([*licenses.PHRASES, *licenses.LICENSE_TEXTS]):
        words = text.split()
        for at in range(len(words) - 1):
            values.append(f"({tid}, '{label}', {str(tid < len(licenses.PHRASES)).lower()}, {at}, "
                          f"{len(words) - 1}, '{words[at]} {words[at + 1]}')")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
with grams(tid, label, base, apos, n_grams, g) as (values {', '.join(values)}),
docs as (
  select row_number() over () as rid, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), '{upper}', '{upper.lower()}'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as words from documents),
pos as (select rid, words, unnest(range(1, len(words))) as i from docs),
hits as (
  select rid, tid, label, base, n_grams, apos, i - 1 - apos as diag
  from pos join grams on words[i] || ' ' || words[i + 1] = g),
diags as (
  select rid, tid, label, base, n_grams, diag, count(*) as votes, min(apos) lo, max(apos) hi,
    bit_or(1::bigint << apos) as grams
  from hits group by all),
places as (select rid, label, diag from diags where base and votes = n_grams),
runs as (
  select *, sum(new) over (partition by rid, tid order by diag rows unbounded preceding) as run from (
    select *, case when diag - lag(diag) over (partition by rid, tid order by diag) <= {licenses.GAP}
      then 0 else 1 end as new from diags where not base)),
spans as (
  select rid, label, bit_count(bit_or(grams)) / n_grams as cover from runs
  group by rid, tid, label, n_grams, run
  having bit_count(bit_or(grams)) / n_grams >= {licenses.MIN_COVER}
    and max(diag + hi + 1) - min(diag + lo) + 1 <= {licenses.MAX_STRETCH} * (n_grams + 1)),
per_base as (
  select rid, count(*) n_base, min(diag) first_word, max(diag) last_word from places group by rid),
found as (
  select rid, label, true as base, 1.0 as cover from places
  union all select rid, label, false, cover from spans),
per_doc as (
  select rid, string_agg(distinct label, ',' order by label) filter (base) base_labels,
    string_agg(distinct label, ',' order by label) labels, max(cover) score
  from found group by rid)
select doc_id, len(words)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base,
  first_word::bigint as first_word, last_word::bigint as last_word,
  coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels,
  round(coalesce(score, 0.0)::double, 6) as score
from docs left join per_base using (rid) left join per_doc using (rid)"""


def op5() -> str:
    # Words in k-word windows that occur twice or more in their text.
    def repeated(k: int) -> str:
        return f"""
w{k} as (select rid, i, count(*) over (partition by rid, hash(list_slice(words, i, i + {k - 1}))) n
  from (select rid, words, unnest(range(1, len(words) - {k - 2})) i from docs)),
r{k} as (select rid, count(distinct i + j) n from w{k}, range({k}) t(j) where n > 1 group by rid)"""

    limit, least = repetition.MAX_REPEAT + 1, repetition.MIN_REPEAT
    return f"""
with docs as (
  select row_number() over () rid, doc_id, coalesce(text, '') t,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') words from documents),
lines as (
  select rid, line, count(*) - 1 n from (select rid, unnest(string_split(t, chr(10))) line from docs)
  where regexp_matches(line, '[^\\x20\\x09-\\x0D]') group by all),
dup as (select rid, sum(n) n from lines group by rid),
{repeated(repetition.WINDOW)}, {repeated(least)}, {repeated(limit)},
counts as (
  select doc_id, len(words)::bigint n_words, length(array_to_string(words, ''))::bigint word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint n_symbols,
    coalesce(dup.n, 0)::bigint n_dup_lines, coalesce(a.n, 0)::bigint n_repeat_words,
    coalesce(b.n, 0) covered, c.n is not null as long_repeat
  from docs left join dup using (rid) left join r{repetition.WINDOW} a using (rid)
  left join r{least} b using (rid) left join r{limit} c using (rid)),
judged as (
  select *, n_words < {repetition.MIN_WORDS} or 100 * n_repeat_words > 50 * n_words as base_failed from counts)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and covered <= {repetition.MAX_COVERED} * n_words and not long_repeat as kept
from judged"""


def op8() -> str:
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in urls.RULES)
    n, upper = urls.ORDER, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    levels = [f"""l{n} as (select g, sum(a) a, sum(b) b from grams group by g)"""]
    for k in range(n - 1, 0, -1):
        levels.append(f"l{k} as (select substr(g, 2) g, sum(a) a, sum(b) b from l{k + 1} group by 1)")
    for k in range(1, n + 1):
        low = (f"join p{k - 1} q on q.g = substr(x.g, 2)" if k > 1
               else f"cross join (select {1 / urls.ALPHABET} pa, {1 / urls.ALPHABET} pb) q")
        levels.append(f"""
c{k} as (select substr(g, 1, {k - 1}) ctx, sum(a) na, sum(b) nb,
  count(*) filter (a > 0) ta, count(*) filter (b > 0) tb from l{k} group by 1),
p{k} as (select x.g,
  case when na > 0 then (a + ta * pa) / (na + ta)::double else pa end as pa,
  case when nb > 0 then (b + tb * pb) / (nb + tb)::double else pb end as pb
  from l{k} x join c{k} on ctx = substr(x.g, 1, {k - 1}) {low})""")
    return f"""
with rules(h, p, v) as (values {rules}),
parts as (
  select url, count(*) n, case when position('://' in url) > 0
    then substr(url, position('://' in url) + 3) else '' end rest from pages group by url),
hp as (
  select url, n, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{upper}', '{upper.lower()}') host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path from parts),
ruled as (
  select url, n, host, path, arg_max(h || p, length(h || p)) as rule, arg_max(v, length(h || p)) as by_rule
  from hp left join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p)
  group by all),
scored as (
  select url s, case when by_rule = 'allow' then n else 0 end a, case when by_rule = 'block' then n else 0 end b
  from ruled where length(url) > 0),
grams as (
  select s, a, b, substr(repeat(chr(2), {n - 1}) || s || chr(3), i, {n}) g
  from (select *, unnest(range(1, length(s) + 2)) i from scored)),
{', '.join(levels)},
scores as (
  select s, any_value(a) a, any_value(b) b, avg(ln(pa) - ln(pb)) d from grams join p{n} using (g) group by s),
stats as (
  select sum(d * a) / sum(a) ma, sum(d * b) / sum(b) mb, sum(a) na, sum(b) nb,
    sqrt(greatest(sum(d * d * a) / sum(a) - (sum(d * a) / sum(a)) ** 2, 0)) sa,
    sqrt(greatest(sum(d * d * b) / sum(b) - (sum(d * b) / sum(b)) ** 2, 0)) sb from scores),
cut as (
  select case when na > 0 and nb > 0 then
    case when sa + sb > 0 then (ma * sb + mb * sa) / (sa + sb) else (ma + mb) / 2 end end as t from stats)
select page_id, coalesce(host, '') host, coalesce(path, '') path, rule,
  coalesce(by_rule, case when d is null or d < t then 'block' else 'allow' end) as verdict
from pages p left join ruled r on p.url is not distinct from r.url
left join scores on s = r.url cross join cut"""


def op10() -> str:
    n = substrings.WINDOW
    return f"""
with docs as (
  select row_number() over () rid, doc_id,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') words from documents),
windows as (
  select rid, i, md5(array_to_string(list_slice(words, i, i + {n - 1}), ' ')) h
  from (select rid, words, unnest(range(1, len(words) - {n - 2})) i from docs)),
again as (select rid, i from windows join (select h from windows group by h having count(*) > 1) using (h)),
gone as (select distinct rid, i + j as i from again, range({n}) t(j)),
kept as (
  select rid, string_agg(word, ' ' order by i) t, count(*) n
  from (select rid, unnest(words) word, unnest(range(1, len(words) + 1)) i from docs)
  anti join gone using (rid, i) group by rid)
select doc_id, len(words)::bigint n_words, (len(words) - coalesce(n, 0))::bigint n_removed,
  sha256(coalesce(t, '')) kept_sha256
from docs left join kept using (rid)"""


def op13() -> str:
    return """
with docs as (
  select doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') t from documents)
select doc_id, min(doc_id) over (partition by t) keep_id, count(*) over (partition by t) group_size,
  row_number() over (partition by t order by doc_id) = 1 kept, sha256(t) text_sha256
from docs"""


ORACLE_SQL = {
    "op3_chat_format": op3(),
    "op4_license_scan": op4(),
    "op5_repetition_rules": op5(),
    "op8_url_filter": op8(),
    "op10_substring_dedup": op10(),
    "op13_exact_dedup": op13(),
}
