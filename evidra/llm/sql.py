"""DuckDB SQL for the operators that SQL can express, over the given tables."""

from __future__ import annotations

from .decontaminate import CONTAINED, WIDTH
from .quality_rules import LEAST_WORDS, LEFT_SHARE, LINE_DOCUMENTS, LINE_LEAST, LINE_SHARE
from .substrings import WIDTH as PASSAGE
from .url_filter import BASE, HELD_OUT, ORDER, RULES

_WORDS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '')"

DECONTAMINATE = rf"""
with items as (select item_id, {_WORDS} w from benchmark),
item_shingles as (select distinct item_id, k, array_to_string(w[i:i + k - 1], ' ') s from (select item_id, w, least({WIDTH}, len(w)) k, unnest(range(1, len(w) - least({WIDTH}, len(w)) + 2)) i from items where len(w) > 0)),
sizes as (select item_id, count(*) n from item_shingles group by item_id),
docs as (select row_number() over () r, doc_id, {_WORDS} w from documents),
doc_shingles as (select distinct r, doc_id, k, array_to_string(w[i:i + k - 1], ' ') s from (select r, doc_id, w, k, unnest(range(1, len(w) - k + 2)) i from docs, (select distinct k from item_shingles) where len(w) >= k))
select doc_id, item_id, n n_shingles, count(*) n_found from doc_shingles join item_shingles using (k, s) join sizes using (item_id)
group by r, doc_id, item_id, n having count(*) >= ceil({CONTAINED}::double * n - 1e-9)"""

_WORD = r"[^\x20\x09-\x0D]+"

LINES = rf"""
with docs as (select row_number() over () r, doc_id, coalesce(source, chr(1)) host, coalesce(text, '') t from documents),
base as (select *, regexp_extract_all(t, '{_WORD}') w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) lines from docs),
windows as (select r, i, count(*) over (partition by r, s) n from (select r, i, w[i]||' '||w[i+1]||' '||w[i+2] s from (select r, w, unnest(range(1, len(w) - 1)) i from base where len(w) > 2))),
repeats as (select r, count(distinct i + d) n from windows, (select unnest([0, 1, 2]) d) where n > 1 group by r),
line as (select r, host, lower(array_to_string(regexp_extract_all(x, '{_WORD}'), ' ')) x, len(regexp_extract_all(x, '{_WORD}')) n from (select r, host, unnest(lines) x from base)),
hosts as (select host, count(*) d from docs group by host),
often as (select host, x from line join hosts using (host) group by host, x, d having count(distinct r) > least({LINE_DOCUMENTS}, greatest({LINE_LEAST}, {LINE_SHARE}::double * d))),
removed as (select r, sum(n) n from line join often using (host, x) group by r),
counted as (select doc_id, len(w) n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) n_symbols, len(lines) - len(list_distinct(lines)) n_dup_lines, coalesce(p.n, 0) n_repeat_words, len(w) - coalesce(q.n, 0)::bigint words_left
  from base left join repeats p using (r) left join removed q using (r))
select *, n_words < {LEAST_WORDS} or 100 * n_repeat_words > 50 * n_words base_failed, not (n_words < {LEAST_WORDS} or 100 * n_repeat_words > 50 * n_words) and words_left >= {LEFT_SHARE}::double * n_words and words_left >= {LEAST_WORDS} kept from counted"""


PASSAGES = rf"""
with docs as (select row_number() over () r, doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') w from documents),
places as (select r, doc_id, unnest(range(1, len(w) - {PASSAGE} + 2)) i, w from docs),
windows as (select r, doc_id, i, md5(array_to_string(w[i:i + {PASSAGE - 1}], ' ')) s from places),
least as (select s, min(doc_id) least from windows group by s),
gone as (select distinct r, i + k i from windows join least using (s), (select unnest(range(0, {PASSAGE})) k) where least < coalesce(doc_id, {2**63 - 1})),
removed as (select r, list(i) places from gone group by r),
lefts as (select doc_id, w, coalesce(len(places), 0) n, case when places is null then w else list_filter(w, lambda x, i: not list_contains(places, i)) end l from docs left join removed using (r))
select doc_id, len(w) n_words, n n_removed, sha256(array_to_string(l, ' ')) kept_sha256 from lefts"""


def _urls() -> str:
    rules = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then" for _, h, p in rules]
    rule = "case " + " ".join(f"{f} '{h}{p}'" for f, (_, h, p) in zip(fits, rules)) + " end"
    verdict = "case " + " ".join(f"{f} '{v}'" for f, (v, _, _) in zip(fits, rules)) + " end"
    steps = [f"t{ORDER} as (select gram, count(*) filter (said = 'allow') allow, count(*) filter (said = 'block') block from (select said, unnest({{grams}}) gram from judged where said is not null and not held) group by gram)"]
    steps += [f"t{k} as (select substring(gram, 2) gram, sum(allow) allow, sum(block) block from t{k + 1} group by 1)" for k in range(ORDER - 1, -1, -1)]
    steps += [f"c{k} as (select substring(gram, 1, {k}) context, sum(allow) n_allow, sum(block) n_block, count(*) filter (allow > 0) k_allow, count(*) filter (block > 0) k_block from t{k} group by 1)" for k in range(ORDER + 1)]
    p = f"p as (select distinct unnest({{grams}}) gram, {BASE}::double p_allow, {BASE}::double p_block from (select distinct line from judged where said is null or held))"
    steps.append(p)
    for k in range(ORDER + 1):
        new = ", ".join(f"case when coalesce(n_{c}, 0) > 0 then (coalesce(t.{c}, 0)::double + k_{c}::double * p_{c}) / (n_{c} + k_{c})::double else p_{c} end p_{c}" for c in ("allow", "block"))
        steps.append(f"p{k} as (select p.gram, {new} from {'p' + str(k - 1) if k else 'p'} p left join t{k} t on t.gram = substring(p.gram, {ORDER - k + 1}) left join c{k} c on c.context = substring(p.gram, {ORDER - k + 1}, {k}))")
    grams = f"list_transform(range(1, length(line) + 2), lambda i: substring(repeat(chr(2), {ORDER})||line||chr(3), i, {ORDER + 1}))"
    return f"""
with parts as (select page_id, case when position('://' in url) > 0 then substring(url, position('://' in url) + 3) else '' end rest from pages),
split as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path from parts),
judged as materialized (select page_id, host, path, host||path line, {rule} "rule", {verdict} said, md5(host||path)[1] in ({', '.join(f"'{x}'" for x in HELD_OUT)}) held from split),
{', '.join(steps).replace('{grams}', grams)},
ratio as (select gram, round(ln(p_allow / p_block) * 1e6)::bigint x from p{ORDER}),
scores as (select line, floor(sum(x)::double / count(*))::bigint score from (select line, unnest({grams}) gram from (select distinct line from judged where said is null or held)) join ratio using (gram) group by line),
lim as (select case when count(*) filter (said = 'allow') > 0 and count(*) filter (said = 'block') > 0 then (sum(score) filter (said = 'allow') / count(*) filter (said = 'allow') + sum(score) filter (said = 'block') / count(*) filter (said = 'block')) / 2 else 0 end v from judged join scores using (line) where said is not null and held)
select page_id, host, path, "rule", coalesce(said, case when score < (select v from lim) then 'block' else 'allow' end) verdict, case when said is null then score end score from judged left join scores using (line)"""


URLS = _urls()
