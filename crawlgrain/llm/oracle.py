"""DuckDB SQL for those queries that SQL can express in full."""

from __future__ import annotations

from crawlgrain.llm.license_scan import RULES, SENTENCES
from crawlgrain.llm.secrets import ACCESS, ALLOWED, ASSIGN, CANDIDATE, HEX, HEX_BITS, MIXED_BITS, PLAIN_BITS, WINDOW
from crawlgrain.llm.source_audit import audit_sql


def _license_sql() -> str:
    known = ", ".join(f"('{k}', '{v}')" for k, v in SENTENCES.items())
    steps, named = [], []
    for i, (name, ids) in enumerate(RULES):
        sought = "|" + "||".join(ids) + "|"
        named.append(f"case when contains(m{i}, '{sought}') then '{name}' end")
        steps.append(f"s{i + 1} as (select *, replace(m{i}, '{sought}', '~') as m{i + 1} from s{i})")
    return f"""with known(id, sentence) as (values {known}),
cut as (select doc_id, string_split(regexp_replace(coalesce(text, ''), '[.;!?]+(\\s|$)', chr(10) || '\\1', 'g'), chr(10)) as parts from documents),
sentences as (select doc_id, unnest(parts) as part, generate_subscripts(parts, 1) as pos from cut),
hits as (select s.doc_id, s.pos, k.id from sentences s join known k on k.sentence = trim(regexp_replace(lower(s.part), '[^a-z0-9]+', ' ', 'g'))),
lists as (select doc_id, count(*) as n, string_agg(id, ',' order by pos) as ids from hits group by doc_id),
s0 as (select d.doc_id, coalesce(n, 0) as n_sentences, coalesce(ids, '') as sentence_ids, '|' || replace(coalesce(ids, ''), ',', '||') || '|' as m0 from documents d left join lists using (doc_id)),
{", ".join(steps)}
select doc_id, cast(n_sentences as bigint) as n_sentences, sentence_ids, array_to_string([x for x in [{", ".join(named)}] if x is not null], ',') as licenses from s{len(RULES)}"""


_CHAT = r"""with c as (select cast(conv_id as bigint) as pair_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
a as (select pair_id, max(turn) as last_turn, arg_max(text, (turn, text)) as answer from c where role = 'assistant' group by 1),
t as (select pair_id, 'chosen' as side, turn, role, text from c union all select c.pair_id, 'rejected', c.turn, c.role, case when c.role = 'assistant' and c.turn = a.last_turn then coalesce(o.answer, '') else c.text end
 from c left join a using (pair_id) left join a o on o.pair_id = xor(c.pair_id, 1)),
r as (select *, row_number() over (partition by pair_id, side order by turn nulls first, role, text) as k from t where pair_id in (select pair_id from t group by 1 having count(distinct side) = 2)),
m as (select a.pair_id, a.k, row_number() over (partition by a.pair_id order by a.k) as rn from r a join r b on a.pair_id = b.pair_id and a.k = b.k and a.side = 'chosen' and b.side = 'rejected' and a.role = b.role and a.text = b.text),
p as (select pair_id, count(*) filter (k = rn) as n from m group by pair_id),
x as (select r.*, coalesce(p.n, 0) as n, '<|' || role || '|>' || chr(10) as opening from r left join p using (pair_id)),
y as (select *, opening || text || '<|end|>' || chr(10) as turn_text, coalesce(sum(case when k > n then length(opening) + length(text) + 8 else 0 end) over (partition by pair_id, side order by k rows between unbounded preceding and 1 preceding), 0) + length(opening) as start_at from x)
select pair_id, max(n) as n_prompt_turns, coalesce(string_agg(turn_text, '' order by k) filter (side = 'chosen' and k <= n), '') as prompt,
 coalesce(string_agg(turn_text, '' order by k) filter (side = 'chosen' and k > n), '') as chosen, coalesce(string_agg(turn_text, '' order by k) filter (side = 'rejected' and k > n), '') as rejected,
 coalesce(string_agg(cast(start_at as bigint) || ':' || cast(start_at + length(text) + 8 as bigint), ',' order by k) filter (side = 'chosen' and k > n and role = 'assistant'), '') as chosen_spans,
 coalesce(string_agg(cast(start_at as bigint) || ':' || cast(start_at + length(text) + 8 as bigint), ',' order by k) filter (side = 'rejected' and k > n and role = 'assistant'), '') as rejected_spans
from y group by pair_id"""

_TOP_K = """with e as (select row_number() over () as rid, vec_id, list_transform(embedding, lambda c: floor(256 * c::double)) as x from embeddings
 where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
s as (select q.rid, q.vec_id as query_id, v.vec_id, list_inner_product(q.x, v.x)::bigint as score, row_number() over (partition by q.rid order by list_inner_product(q.x, v.x) desc, v.vec_id, v.rid)::int as rank
 from e q join e v on len(q.x) = len(v.x) and q.rid <> v.rid where q.vec_id % 50 = 0)
select query_id, rank, vec_id, score from s where rank <= 5"""


def _secrets_sql() -> str:
    quote = lambda text: "'" + text.replace("'", "''").replace("\\x20", " ") + "'"
    patterns = [quote(ASSIGN), quote(ACCESS), quote(HEX), quote(CANDIDATE.partition(")")[2])]
    found = ", ".join(f"string_split_regex(t, {r}) as p{k}, regexp_extract_all(t, {r}, 0) as m{k}" for k, r in enumerate(patterns))

    def spans(k: int, good: str) -> str:
        start = f"cast(list_sum([length(x) for x in p{k}[1:i]]) + coalesce(list_sum([length(x) for x in m{k}[1:i-1]]), 0) as bigint)"
        return f"[{{'s': {start}, 'k': {k}, 'e': {start} + length(m{k}[i])}} for i in range(1, len(m{k}) + 1) if {good}]"

    windows = f"[list_entropy(string_split(substr(m3[i], j, {WINDOW}), '')) for j in range(1, greatest(length(m3[i]) - {WINDOW - 2}, 2))]"
    least = f"case when regexp_full_match(m3[i], '[0-9a-fA-F]+') then {HEX_BITS} when regexp_full_match(m3[i], '[0-9a-z]+|[0-9A-Z]+') then {PLAIN_BITS} else {MIXED_BITS} end"
    random = f"regexp_matches(m3[i], '[0-9]') and not regexp_matches(m3[i], {quote(ALLOWED)}) and list_max({windows}) >= {least}"
    said = "coalesce(array_to_string([['assign', 'access', 'hex', 'entropy'][b.k + 1] || ':' || b.s || ':' || b.e for b in {}], ','), '')"
    return f"""with d as (select doc_id, coalesce(text, '') as t from documents), m as (select doc_id, regexp_extract_all(t, {patterns[0]}, 2) as g0, {found} from d),
s as (select doc_id, {spans(0, "length(g0[i]) >= 6")} as a0, {spans(1, "length(m1[i]) >= 20")} as a1, {spans(2, "true")} as a2, {spans(3, random)} as a3 from m),
b as (select *, list_sort(a0 || a1 || a2) as base from s), f as (select *, list_sort(base || [x for x in a3 if len([y for y in base if y.s < x.e and x.s < y.e]) = 0]) as found from b)
select doc_id, cast(len(a0) as bigint) as n_assign, cast(len(a1) as bigint) as n_access, cast(len(a2) as bigint) as n_hex, sha256({said.format("base")}) as base_sha256, {said.format("found")} as spans from f"""


ORACLES: dict[str, str] = {
    "op8_secret_scans": _secrets_sql(),
    "op2_license_scans": _license_sql(),
    "op10_chat_formatting": _CHAT,
    "op12_source_divergence_audit": audit_sql(),
    "op13_exact_top_k": _TOP_K,
}
