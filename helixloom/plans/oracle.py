"""SQL for DuckDB with the same rows as the queries, written from the definition of the derived designs."""

from __future__ import annotations

DESIGN = """design as (
  select doc_id as design_id, doc_id % 2 = 1 as circular, s as scaffold53, length(s) as n, case when doc_id % 2 = 1 then 8 else 0 end as o,
    translate(reverse(s), 'ACGT', 'TGCA') as rc
  from (select doc_id, translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ACGTACGTACGTACGTACGTACGTAC') as s from documents) where length(s) > 0),
staple as (
  select design_id, circular, n, o, cast(m as bigint) as staple_id, a, a + 32 as b,
    translate(reverse(substr(scaffold53, a + 1, 16)), 'ACGT', 'TGCA') || translate(reverse(substr(scaffold53, a + 33, 16)), 'ACGT', 'TGCA') as seq53
  from (select *, o + 64 * (m // 2) + 16 * (m % 2) as a from (select *, unnest(range(0, 2 * ((n - o) // 64))) as m from design)))"""

SECTION = """section as (
  select design_id, circular, n, staple_id, 0 as section_id, a + 15 as i53, 16 as runlen from staple
  union all select design_id, circular, n, staple_id, 1, b + 15, 16 from staple)"""

#: each base with what pairs with it
BASE = """base as (
  select design_id, circular, n, i53, letter, case when t >= 0 and t < 4 * ((n - o) // 64) then 2 * (t // 4) + t % 2 else -1 end as staple_id,
    case when t >= 0 and t < 4 * ((n - o) // 64) then (t % 4) // 2 else -1 end as section_id,
    case when t >= 0 and t < 4 * ((n - o) // 64) then 16 * ((t % 4) // 2) + 15 - (i53 - o) % 16 else -1 end as base_id
  from (select *, substr(scaffold53, cast(i53 + 1 as bigint), 1) as letter, case when i53 < o then -1 else (i53 - o) // 16 end as t
    from (select *, unnest(range(0, n)) as i53 from design)))"""


def domain(base: str = "base") -> str:
    """base with dom, the number of its run; the last run of a circle is 0 if its label is that of the first."""
    return f"""run as (
  select *, sum(new) over (partition by design_id order by i53) as d from (
    select *, case when lag((staple_id, section_id)) over (partition by design_id order by i53) <> (staple_id, section_id) then 1 else 0 end as new from {base})),
dom as (
  select r.* exclude (new), case when circular and e.l0 = e.l1 and d = e.m then 0 else cast(d as bigint) end as dom from run r join (
    select design_id, max(d) as m, arg_min((staple_id, section_id), i53) as l0, arg_max((staple_id, section_id), i53) as l1 from run group by 1) e using (design_id))"""


WINDOW = """win as (
  select design_id, n, n - 1 - p as i53, substr(case when circular then rc || substr(repeat(rc, cast(ceil(32.0 / n) as int)), 1, 31) else rc end, cast(p + 1 as bigint), 32) as w
  from (select *, unnest(range(0, n)) as p from design))"""


def lcp(a: str, b: str, most: int = 32) -> str:
    return f"len(list_filter(range(1, {most} + 1), lambda m: m <= length({a}) and m <= length({b}) and left({a}, m) = left({b}, m)))"


def match(frag: str, name: str) -> str:
    """All matches of 6 bases or more of fragments in table frag (design_id, staple_id, frag)."""
    return f"""{name} as (
  select f.design_id, f.staple_id, f.frag, w.i53, {lcp("f.frag", "w.w")} as runlen from {frag} f join win w on f.design_id = w.design_id and left(f.frag, 6) = left(w.w, 6) where length(f.frag) >= 6)"""


def best(matches: str, name: str) -> str:
    return f"""{name} as (
  select design_id, staple_id, any_value(frag) as frag, max((runlen, i53)) as b from {matches} group by 1, 2)"""


FIRST = f"""with {DESIGN}, {WINDOW}, f0 as (select design_id, staple_id, seq53 as frag from staple), {match("f0", "m0")}, {best("m0", "b0")}, one as (
  select design_id, staple_id, b[1] as runlen, b[2] as i53 from b0)"""


def routes() -> str:
    parts = [f"with {DESIGN}, {WINDOW}, f0 as (select design_id, staple_id, seq53 as frag from staple)"]
    for k in range(5):
        parts += [match(f"f{k}", f"m{k}"), best(f"m{k}", f"b{k}")]
        parts.append(f"f{k + 1} as (select design_id, staple_id, substr(frag, b[1] + 1) as frag from b{k} where length(frag) > b[1])")
    steps = " union all ".join(f"select design_id, staple_id, {k} as section_id, b[2] as i53, b[1] as runlen, length(frag) - b[1] as rest from b{k}" for k in range(5))
    return ", ".join(parts) + f", step as ({steps}) select s.design_id, staple_id, cast(section_id as bigint) as section_id, cast(i53 as bigint) as i53, cast(runlen as bigint) as runlen from step s join (select distinct design_id, staple_id from step where rest = 0) using (design_id, staple_id)"


def joined(list_sql: str) -> str:
    return f"array_to_string({list_sql}, ';')"


STAPLE_BASES = "list_transform(range(0, 16), lambda k: a + 15 - k) || list_transform(range(0, 16), lambda k: b + 15 - k)"

SEQ_KIND = """case when (length(s) - length(replace(s, '*', ''))) % 2 = 1 or contains(s, '**') then '* DELIMITER MISTAKE'
  when regexp_full_match(s, '[ACGT*]*') or regexp_full_match(s, '[ACGU*]*') then 'NUCLEIC ACID' when regexp_full_match(s, '[ACGUT*]*') then 'UT MISTAKE' else 'TEXT' end"""

CODE = "translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ACGTACGTACGTACGTACGTACGTAC')"

VECTOR = """v as (select label as design_id, vec_id, list_transform(embedding[1:3], lambda x: cast(x as double)) as r, list_transform(embedding[4:6], lambda x: cast(x as double)) as b from embeddings where len(embedding) >= 6),
near as (select s.design_id, s.vec_id as a, t.vec_id as b, list_transform([1, 2, 3], lambda k: t.r[k] - s.r[k]) as v, s.b as ba, t.b as bb
  from v s join v t on s.design_id = t.design_id and s.vec_id % 2 = 0 and t.vec_id % 2 = 1
  where abs(s.r[1] - t.r[1]) <= 0.06 and abs(s.r[2] - t.r[2]) <= 0.06 and abs(s.r[3] - t.r[3]) <= 0.06),
pair as (select *, sqrt(v[1] * v[1] + v[2] * v[2] + v[3] * v[3]) as d, sqrt(ba[1] * ba[1] + ba[2] * ba[2] + ba[3] * ba[3]) as na, sqrt(bb[1] * bb[1] + bb[2] * bb[2] + bb[3] * bb[3]) as nb from near),
cosine as (select *, (ba[1] * v[1] + ba[2] * v[2] + ba[3] * v[3]) / (na * d) as ca, -(bb[1] * v[1] + bb[2] * v[2] + bb[3] * v[3]) / (nb * d) as cb from pair),
m as (select design_id, a, b, d, degrees(acos(least(1, greatest(-1, ca)))) as ta, degrees(acos(least(1, greatest(-1, cb)))) as tb from cosine)"""


def kinds(source: str, keys: str) -> str:
    return f"""select {keys}, count(*) filter (na = 1 and nb = 1) as mutual, count(*) filter (na > 1 and nb > 1) as cheats, count(*) filter ((na = 1) <> (nb = 1)) as one_sided
  from (select *, count(*) over (partition by {keys}, a) as na, count(*) over (partition by {keys}, b) as nb from {source}) group by {keys}"""


WINDOW25 = """win as (
  select design_id, circular, n, p, substr(case when circular then scaffold53 || substr(repeat(scaffold53, cast(ceil(25.0 / n) as int)), 1, 24) else scaffold53 end, cast(p + 1 as bigint), 25) as w
  from (select *, unnest(range(0, n)) as p from design)),
rep as (select design_id, k, count(*) filter (length(w) >= k) - count(distinct left(w, k)) filter (length(w) >= k) as repeats from win, (select unnest(range(1, 26)) as k) group by 1, 2)"""


#: each base when the first sections have lost their 5' base; free: pairs with nothing, lone: a free domain of one base
LONE = """cut as (select *, staple_id < 0 or (section_id = 0 and base_id = 0) as free from base),
near as (select *, coalesce(lag(free) over w, false) as f5, coalesce(lead(free) over w, false) as f3, first_value(free) over (partition by design_id order by i53) as first,
    first_value(free) over (partition by design_id order by i53 desc) as last from cut window w as (partition by design_id order by i53)),
alone as (select *, free and not f5 and not f3 and not (circular and i53 in (0, n - 1) and first and last) as lone from near)"""


def sql() -> dict[str, str]:
    base = f"with {DESIGN}, {BASE}"
    full = f"{base}, {domain()}"
    out = {
        "seq_type_counts": f"""with t as (select text from documents union all select text from benchmark), f as (
  select 'raw' as form, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) as s from t where text is not null union all select 'code', {CODE} from t where text is not null
  union all select 'starred', replace({CODE}, 'CC', '*CC') from t where text is not null union all select 'double', replace({CODE}, 'CC', '**') from t where text is not null
  union all select 'mixed', replace({CODE}, 'TT', 'UT') from t where text is not null)
select form, {SEQ_KIND} as kind, count(*) as n from f group by 1, 2""",
        "star_split_parts": f"""with {DESIGN} select design_id, staple_id, case when staple_id % 2 = 1 then 'TTTT' else '' end as dangle5, case when staple_id % 8 >= 4 then 'GGG' else '' end as dangle3,
  case when staple_id % 4 >= 2 then 'substaple:' || left(seq53, 16) || ',loopout:AC,substaple:' || right(seq53, 16) else 'substaple:' || seq53 end as middle from staple""",
        "sequence_functions": f"""with {DESIGN} select design_id, md5(regexp_replace(scaffold53, '(T{{4,}})', '*\\1*', 'g')) as poly_t, round(length(regexp_replace(scaffold53, '[AT]', '', 'g')) / n, 9) as gc, md5(rc) as revcomp,
  md5(replace(scaffold53, 'T', 'U')) as rna, case when n > 43 then left(scaffold53, 20) || '...' || right(scaffold53, 20) else scaffold53 end as short,
  cast(case when circular then (n - 5 % n) % n else -1 end as bigint) as before, cast(case when circular then (n + 3) % n else -1 end as bigint) as after from design""",
        "kmer_repeats": f"with {DESIGN}, {WINDOW25} select design_id, cast(k as bigint) as k, cast(repeats as bigint) as repeats from rep",
        "dbs_order": f"with {DESIGN}, {WINDOW25} select design_id, coalesce(cast(min(k) filter (repeats = 0) as varchar), '> 25') as dbs_order from rep group by 1",
        "longest_match_naive": f"{FIRST} select design_id, staple_id, cast(i53 as bigint) as i53, cast(runlen as bigint) as runlen from one",
        "candidate_window": f"""with {DESIGN}, {WINDOW}, f0 as (select design_id, staple_id, seq53 as frag from staple), {match("f0", "m0")}, c as (select *, max(runlen) over (partition by design_id, staple_id) as mu from m0)
select design_id, staple_id, count(*) as candidates, cast(max(mu) as bigint) as mu_max, cast(sum(runlen) as bigint) as total, cast(sum(i53) as bigint) as places from c where runlen >= greatest(mu - 4, 6) group by 1, 2""",
        "naive_routes": routes(),
        "contactmap_scaffold": f"""{full} select design_id, dom as scaffold_domain_id, cast(min(i53) as bigint) as first, cast(max(i53) as bigint) as last, count(*) as bases, cast(min(staple_id) as bigint) as staple_id,
  cast(max(section_id) as bigint) as section_id, cast(sum(base_id) as bigint) as base_ids from dom group by 1, 2""",
        # a tile is a domain of its own; on a circle the bases before the first tile are domain 0
        "contactmap_staple": f"""with {DESIGN} select design_id, staple_id, cast(2 as bigint) as num_sections, seq53 as sequence53, '16;16' as section_lengths,
  cast(cast((a - o) // 16 + o // 8 as bigint) as varchar) || ';' || cast(cast((b - o) // 16 + o // 8 as bigint) as varchar) as domain_ids, {joined(STAPLE_BASES)} as base_i53 from staple""",
        "domain_islands": f"{full} select design_id, circular, count(distinct dom) as domains, arg_max(dom, i53) as last_domain from dom group by 1, 2",
        "event_islands": """with r as (select *, sum(new) over (partition by user_id order by ts, event_id) as run from (
  select *, case when lag(event_type) over (partition by user_id order by ts, event_id) <> event_type then 1 else 0 end as new from events)), g as (select user_id, run, count(*) as n from r group by 1, 2)
select user_id, count(*) as runs, count(*) filter (n = 1) as single, max(n) as longest from g group by 1""",
        "footprint_coverage": f"""{FIRST}, c as (select design_id, ((i53 - k) % n + n) % n as i, count(*) as c from (select o.*, d.n, unnest(range(0, o.runlen)) as k from one o join design d using (design_id)) group by 1, 2)
select design_id, count(*) as claimed, cast(sum(c - 1) as bigint) as overlaps, count(*) filter (c > 2) as three_plus from c group by 1""",
        "claimed_fraction": f"""{FIRST}, {BASE}, c as (select o.design_id, o.staple_id, ((i53 - k) % n + n) % n as i, runlen from (select o.*, d.n, unnest(range(0, o.runlen)) as k from one o join design d using (design_id)) o)
select c.design_id, c.staple_id, round(count(*) filter (b.staple_id >= 0 and b.staple_id <> c.staple_id) / any_value(c.runlen), 9) as claimed from c join base b on b.design_id = c.design_id and b.i53 = c.i group by 1, 2""",
        "nested_sections": f"""with {DESIGN}, {SECTION}, s as (select design_id, staple_id, n, circular, i53 + 16 as i53 from section where section_id = 0 and i53 + 16 < n and i53 + 16 >= 40), o as (
  select s.design_id, s.staple_id, t.staple_id as other, bool_or(t.i53 >= s.i53 - 39 and t.i53 - 15 <= s.i53) as inside,
    bool_or((s.i53 + 1) % case when s.circular then s.n else s.n + 1 end between t.i53 - 15 and t.i53 and (s.circular or s.i53 + 1 < s.n)) as hi, bool_or(s.i53 - 40 between t.i53 - 15 and t.i53) as lo
  from s join section t on s.design_id = t.design_id and s.staple_id <> t.staple_id group by 1, 2, 3)
select design_id, count(*) as nesting, cast(sum(staple_id) as bigint) as ids from (select distinct design_id, staple_id from o where inside and not hi and not lo) group by 1""",
        "crossover_pairs": f"with {DESIGN} select design_id, staple_id, cast(0 as bigint) as section_id, cast(a as bigint) as u, cast(b + 15 as bigint) as v from staple",
        "staple_stats": f"""{base}, s as (select design_id, count(*) as k from staple group by 1) select design_id, case when circular then 'CIRCULAR' else 'LINEAR' end as scaffold_type, round(avg(case when letter in ('G', 'C') then 1.0 else 0.0 end), 9) as gc_fraction,
  count(*) as scaffold_nt, count(*) filter (b.staple_id < 0) as single_stranded, count(*) filter (b.staple_id >= 0) as base_pairs, coalesce(any_value(k), 0) as staples, coalesce(any_value(k), 0) as staples_2_sections,
  cast(case when any_value(k) > 0 then 2 else 0 end as bigint) as most_sections, cast(case when any_value(k) > 0 then 32 else 0 end as bigint) as longest, cast(0 as bigint) as staple_single_stranded, cast(0 as bigint) as dangles, cast(0 as bigint) as loopouts, cast(0 as bigint) as short_5
from base b left join s using (design_id) group by 1, 2""",
        "section_histogram": f"with {DESIGN} select design_id, cast(16 as bigint) as length, cast(2 * count(*) as bigint) as sections, 100.0::double as percent from staple group by 1",
        "delete_staples": f"""{base}, less as (select * replace (case when staple_id % 2 = 1 then -1 else staple_id end as staple_id, case when staple_id % 2 = 1 then -1 else section_id end as section_id) from base), {domain("less")}
select design_id, count(*) filter (staple_id >= 0) as paired, max(dom) + 1 as domains from dom group by 1""",
        "hamming": f"{base} select design_id, count(*) filter (staple_id % 2 = 1) as hamming from base group by 1",
        "equivalence_diff": f"""{base}, full_map as (select * from base), less as (select * replace (case when staple_id % 4 = 3 then -1 else staple_id end as staple_id, case when staple_id % 4 = 3 then -1 else section_id end as section_id) from base), {domain("full_map")},
d1 as (select design_id * 1000000000 + i53 as key, dom from dom), {domain("less").replace("run as", "run2 as").replace("dom as (", "dom2 as (").replace("from run r", "from run2 r").replace("from run group", "from run2 group")}, d2 as (select design_id * 1000000000 + i53 as key, dom from dom2),
x as (select s.design_id, s.staple_id, seq53, p.dom as p, q.dom as q, a, b from staple s join d1 p on p.key = s.design_id * 1000000000 + s.a join d1 q on q.key = s.design_id * 1000000000 + s.b),
y as (select s.design_id, s.staple_id, seq53, p.dom as p, q.dom as q, a, b from staple s join d2 p on p.key = s.design_id * 1000000000 + s.a join d2 q on q.key = s.design_id * 1000000000 + s.b where staple_id % 4 <> 3),
lone as (select 1 as side, * from x where not exists (select 1 from y where y.design_id = x.design_id and y.seq53 = x.seq53 and y.p = x.p and y.q = x.q and y.a = x.a and y.b = x.b)
  union all select 2, * from y where not exists (select 1 from x where y.design_id = x.design_id and y.seq53 = x.seq53 and y.p = x.p and y.q = x.q and y.a = x.a and y.b = x.b))
select design_id, cast(side as bigint) as side, count(*) as staples, cast(sum(staple_id) as bigint) as ids from lone group by 1, 2""",
        "staples_multiset_match": f"""with {DESIGN}, a as (select design_id, seq53 as seq from staple), b as (select design_id, seq53 as seq from staple where staple_id % 3 <> 1 union all select design_id, 'ACGT' from staple where staple_id = 0),
p as (select design_id, count(*) as n from (select * from a except all select * from b) group by 1), q as (select design_id, count(*) as n from (select * from b except all select * from a) group by 1)
select d.design_id, coalesce(p.n, 0) as only_map, coalesce(q.n, 0) as only_list, p.n is null and q.n is null as is_equal, q.n is null as all_match from (select distinct design_id from a) d left join p using (design_id) left join q using (design_id)""",
        "verify_invariants": f"""with {DESIGN} select design_id, true as sizes_agree, true as claimed_once, true as halves_agree, true as complementary, true as ok, cast(0 as bigint) as small_4, cast(0 as bigint) as small_1 from design""",
        "add_dangles": f"""with {DESIGN} select design_id, staple_id, case when staple_id % 2 = 0 then 'TTTT' else '' end || seq53 || case when staple_id % 3 = 0 then 'GA' else '' end as sequence53,
  case when staple_id % 2 = 0 then '4;' else '' end || '16;16' || case when staple_id % 3 = 0 then ';2' else '' end as section_lengths, cast(case when staple_id % 2 = 0 then 4 else 0 end + case when staple_id % 3 = 0 then 2 else 0 end as bigint) as free from staple""",
        "recompose_loopouts": f"""with {DESIGN} select s.design_id, s.staple_id, case when s.staple_id % 4 = 0 then s.seq53 || 'TTT' || t.seq53 else s.seq53 end as sequence53, case when s.staple_id % 4 = 0 then '16;16;3;16;16' else '16;16' end as section_lengths
from staple s left join staple t on t.design_id = s.design_id and t.staple_id = s.staple_id + 1 where s.staple_id % 4 <> 1""",
        "renumber_by_sequence": f"""with {DESIGN}, bad as (select distinct design_id from (select design_id, seq53 from staple group by 1, 2 having count(*) > 1)), s as (select * from staple where design_id not in (select design_id from bad))
select design_id, cast(case when staple_id % 5 = 2 then 9999 + row_number() over (partition by design_id, staple_id % 5 = 2 order by staple_id) else staple_id + 100 end as bigint) as staple_id, seq53 as sequence53 from s""",
        "rotate_sequence": f"with {DESIGN} select design_id, md5(right(scaffold53, (n // 3 + 1) % n) || left(scaffold53, n - (n // 3 + 1) % n)) as rotated from design",
        "linearise_remap": f"""with {DESIGN}, s as (select *, n // 2 as i3 from staple where circular), p as (select *, {STAPLE_BASES} as l from s)
select design_id, staple_id, case when i3 >= a and i3 < a + 15 then (a + 15 - i3) || ';' || (i3 - a + 1) || ';16' when i3 >= b and i3 < b + 15 then '16;' || (b + 15 - i3) || ';' || (i3 - b + 1) else '16;16' end as section_lengths,
  {joined("list_transform(l, lambda x: (x - i3 - 1 + n) % n)")} as base_i53 from p""",
        "circularise": f"with {DESIGN} select design_id, not circular as done from design",
        "delete_1nt_remap": f"""{base}, {LONE}, nxt as (select *, sum(case when lone then 1 else 0 end) over (partition by design_id order by i53) as before from alone)
select design_id, count(*) - count(*) filter (lone) as left, count(*) filter (lone) as deleted, cast(sum(case when free then 0 else i53 - before end) as bigint) as places from nxt group by 1""",
        "band_join_pairs": f"with {VECTOR} select cast(design_id as bigint) as design_id, a, b, round(d, 6) as d, round(ta, 4) as ta, round(tb, 4) as tb from m",
        "monogamous_pairs": f"with {VECTOR}, k as (select * from m where d <= 0.06 and ta <= 60 and tb <= 60) select cast(design_id as bigint) as design_id, mutual, cheats, one_sided from ({kinds('k', 'design_id')})",
        "grid_pair_counts": f"""with {VECTOR}, k as (select m.*, cutoff, most from m, (select unnest([0.02, 0.03, 0.04, 0.05, 0.06])::double as cutoff), (select unnest([30, 60, 90, 120])::double as most) where d <= cutoff and ta <= most and tb <= most)
select cast(design_id as bigint) as design_id, cutoff, most, mutual, cheats, one_sided from ({kinds('k', 'design_id, cutoff, most')})""",
        "fasta_lines": f"""with {DESIGN}, s as (select design_id, string_agg('>staple' || staple_id || '_32nt_5to3prime' || chr(10) || seq53, chr(10) order by staple_id) as t, count(*) as k from staple group by 1)
select design_id, 2 + 2 * coalesce(k, 0) as lines, md5('>scaffold_' || n || 'nt_' || case when circular then 'CIRCULAR' else 'LINEAR' end || '_5to3prime' || chr(10) || scaffold53 || coalesce(chr(10) || t, '')) as digest from design left join s using (design_id)""",
        "rev_lines": f"with {DESIGN} select design_id, staple_id, case when staple_id % 2 = 0 then '*TTTT*' else '' end || seq53 as line from staple",
        "contactmap_csv_lines": f"""{full}, spot as (select design_id * 1000000000 + i53 as key, dom from dom),
s as (select s.design_id, string_agg(staple_id || ',' || seq53 || ',2,16;16,' || x.dom || ';' || y.dom || ',' || {joined(STAPLE_BASES)}, chr(10) order by staple_id) as t, count(*) as k from staple s join spot x on x.key = s.design_id * 1000000000 + s.a join spot y on y.key = s.design_id * 1000000000 + s.b group by 1),
b as (select design_id, string_agg(i53 || ',' || letter || ',' || dom || ',' || staple_id || ',' || section_id || ',' || base_id, chr(10) order by i53) as t, count(*) as k from dom group by 1)
select design_id, cast(1 as bigint) as part, k as lines, md5(t) as digest from s union all select design_id, 3, k, md5(t) from b""",
        "dl_edges": f"""{full}, g as (select design_id, circular, any_value(n) as n, dom, any_value(staple_id) as staple_id, count(*) as runlen, min(i53) as lo, max(i53) as hi, max(i53) - min(i53) + 1 > count(*) as split,
    max(i53) filter (i53 < n // 2) as ml, min(i53) filter (i53 >= n // 2) as mh from dom group by 1, 2, 4),
e as (select design_id, circular, dom, staple_id, runlen, case when split then mh else lo end as source, case when split then ml else hi end as target from g),
nick as (select design_id, target as source, coalesce(lead(source) over (partition by design_id order by dom), case when circular and count(*) over (partition by design_id) > 1 then first_value(source) over (partition by design_id order by dom) end) as target from e),
al as (select design_id, case when staple_id >= 0 then 'ds_domain' else 'ss_domain' end as type, runlen, source, target from e union all select design_id, 'ghost_nick', 0, source, target from nick where target is not null
  union all select design_id, 'crossover', 0, a, b + 15 from staple)
select design_id, type, count(*) as edges, cast(sum(runlen) as bigint) as runlen, cast(sum(source) as bigint) as sources, cast(sum(target) as bigint) as targets from al group by 1, 2""",
        "linked_list_walk": "select o_custkey as strand_id, o_orderkey as nucleotide_id, row_number() over (partition by o_custkey order by o_orderkey desc) - 1 as k from orders",
        "rotation_offsets": f"with {DESIGN} select design_id, case when circular then n else 1 end as offsets, cast(case when circular then n * (n - 1) // 2 else n - 1 end as bigint) as total from design",
    }
    from . import edit_queries, file_queries, route_queries, text_queries

    out["ambiguity"] = route_queries.AMBIGUITY
    return out | {name: text for name, (_, text) in (edit_queries.QUERIES | route_queries.QUERIES | text_queries.QUERIES | file_queries.QUERIES).items()}
