"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations

from parkflow.llm.pii import BONUS, CONTEXT, PART, SCORES, nearby

WORD = r"[^\x20\x09-\x0D]+"

OP7 = """with v as (select vec_id, list_transform(embedding, lambda x: floor(256*cast(x as double))) as e from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x)))=0),
 s as (select q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.e, c.e) as bigint) as score from v q join v c on q.vec_id%50=0 and q.vec_id<>c.vec_id and len(q.e)=len(c.e)),
 r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank from s) select query_id, rank, vec_id, score from r where rank<=5"""



def _place(r: int) -> str:
    share = f"((start+{r}*source_size+size/2)/greatest(target, start+{r}*source_size+size))"
    return f"case when least(size, floor(target)-{r}*source_size-start)>0 then round(case when g=0 then {share} else (sqrt((1-g)*(1-g)+4*g*{share})-(1-g))/(2*g) end,9) end"


OP8 = rf"""with d as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text,''), '{WORD}')) as bigint) as size, md5(coalesce(cast(doc_id as varchar),'')) as rk from documents),
 s as (select source, cast(sum(size) as bigint) as source_size from d group by 1), w as (select *, (row_number() over (order by source nulls last)-1)%3+1 as weight from s), r as (select *, 3*source_size/weight as room from w),
 k as (select *, cast(sum(source_size) over () - 3*coalesce(sum(source_size) over (order by room, source nulls last rows between unbounded preceding and 1 preceding),0) as double) as lft, cast(sum(weight) over () - coalesce(sum(weight) over (order by room, source nulls last rows between unbounded preceding and 1 preceding),0) as double) as ws from r),
 f as (select lft/ws as share from k where lft/ws<=room order by room, lft, ws limit 1), t as (select source, source_size, weight, least(cast(3*source_size as double), weight*(select share from f)) as target from k),
 c as (select d.*, source_size, target, weight, cast(coalesce(sum(size) over (partition by d.source order by rk, doc_id, size rows between unbounded preceding and 1 preceding),0) as bigint) as start from d join t on d.source is not distinct from t.source),
 o as (select *, cast(case when source_size>0 then floor(floor(target)/source_size) else 0 end as bigint) as rounds, case weight when 1 then -0.5 when 3 then 0.5 else 0.0 end as g from c),
 p as (select *, cast(rounds*size + greatest(0, least(size, floor(target)-rounds*source_size-start)) as bigint) as taken from o)
 select doc_id, source, size, source_size, target, taken, {_place(0)} as first_position, {_place(1)} as second_position, {_place(2)} as third_position from p"""

OP2 = rf"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '{WORD}') as w from documents where doc_id is not null),
 g as (select doc_id, list_distinct(case when len(w)=0 then [] when len(w)<3 then [array_to_string(w,' ')] else list_transform(range(1,len(w)-1), lambda i: w[i]||' '||w[i+1]||' '||w[i+2]) end) as g from w),
 n as (select doc_id, cast(len(g) as bigint) as n from g), s as (select doc_id, unnest(g) as g from g),
 c as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b using (g) where a.doc_id<b.doc_id group by 1,2),
 e as (select a, b from c join n x on x.doc_id=a join n y on y.doc_id=b where 100*c>=85*(x.n+y.n-c)), l as (select a, b from e union all select b, a from e),
 reach as (select doc_id as a, doc_id as b from n union select reach.a, l.b from reach join l on reach.b=l.a), m as (select a, min(b) as component_id from reach group by 1)
 select doc_id, n as n_shingles, component_id, doc_id=component_id as kept from n join m on a=doc_id"""


def _doubled(of: str, parts: tuple[tuple[str, int], ...]) -> str:
    """A hash of a window, from those of windows of which it consists."""
    return f"hash({', '.join(f'lead({h},{k}) over w' if k else h for h, k in parts)}) as {of}"


def _op12() -> str:
    hashes = {"h2": (("h1", 0), ("h1", 1)), "h4": (("h2", 0), ("h2", 2)), "h5": (("h4", 0), ("h1", 4)), "h8": (("h4", 0), ("h4", 4)), "h10": (("h8", 0), ("h2", 8)), "h16": (("h8", 0), ("h8", 8)), "h32": (("h16", 0), ("h16", 16)), "h51": (("h32", 0), ("h16", 32), ("h2", 48), ("h1", 50))}
    steps, last = [], "a0"
    for k, (of, parts) in enumerate(hashes.items(), 1):
        steps.append(f"a{k} as (select *, {_doubled(of, parts)} from {last} window w as (partition by doc_id order by i))")
        last = f"a{k}"
    twice = ", ".join(f"(i<=n-{k - 1} and count(*) over (partition by doc_id, h{k}, i<=n-{k - 1})>1) as t{k}" for k in (5, 10, 51))
    within = ", ".join(f"bool_or(t{k}) over (partition by doc_id order by i rows between {k - 1} preceding and current row) as c{k}" for k in (5, 10))
    return rf"""with d as (select doc_id, coalesce(text,'') as text, regexp_extract_all(coalesce(text,''), '{WORD}') as w from documents),
 a0 as (select doc_id, i, n, hash(x) as h1 from (select doc_id, len(w) as n, unnest(w) as x, generate_subscripts(w,1) as i from d)), {', '.join(steps)},
 b as (select *, {twice} from {last}), c as (select doc_id, t51, {within} from b),
 r as (select doc_id, count(*) filter (c5) as n_repeat_words, count(*) filter (c10) as covered_words, bool_or(t51) as long_repeat from c group by 1),
 m as (select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(list_sum(list_transform(w, lambda x: length(x))),0) as bigint) as word_chars, cast(len(regexp_extract_all(text,'[#*$%&|<>]')) as bigint) as n_symbols,
  cast(len(list_filter(string_split(text,chr(10)), lambda x: regexp_matches(x,'{WORD}')))-len(list_distinct(list_filter(string_split(text,chr(10)), lambda x: regexp_matches(x,'{WORD}')))) as bigint) as n_dup_lines, coalesce(n_repeat_words,0) as n_repeat_words, coalesce(covered_words,0) as covered_words, coalesce(long_repeat,false) as long_repeat from d left join r using (doc_id)),
 f as (select *, n_words<10 or 100*n_repeat_words>20*n_words as base_failed from m)
 select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and 100*covered_words<=15*n_words and not long_repeat as kept, covered_words from f"""



def _crc32(text: str) -> str:
    """CRC-32 of an ASCII text, unsigned."""
    bit = "lambda x, z: case when x&1=1 then xor(x>>1, 3988292384) else x>>1 end"
    codes = f"list_transform(string_split({text},''), lambda c: cast(ascii(c) as bigint))"
    return f"xor(list_reduce(list_prepend(cast(4294967295 as bigint), {codes}), lambda a, b: list_reduce([xor(a,b),0,0,0,0,0,0,0,0], {bit})), 4294967295)"


def _op11() -> str:
    key = "md5(octet_length(encode(role))||':'||role||text)"
    return rf"""with t as (select conv_id, turn, coalesce(role,'') as role, coalesce(text,'') as text from conversations where conv_id is not null),
 k as (select conv_id, turn, {key} as k, cast(len(regexp_extract_all(text,'{WORD}')) as bigint) as w from t), o as (select conv_id, k, w, row_number() over (partition by conv_id order by turn nulls first, k, w)-1 as pos from k),
 i as (select conv_id, conv_id-conv_id%20 as base, {_crc32('cast(conv_id as varchar)')}%4 as h from (select distinct conv_id from o)),
 r as (select i.conv_id, pos, k, w, 0 as part from i join o on o.conv_id=base and pos<h union all select conv_id, pos, k, w, 1 from o join i using (conv_id) where pos>=h),
 s as (select conv_id, list(k order by part, pos) as ks, list(w order by part, pos) as ws from r group by 1), c as (select conv_id, coalesce(ks,[]) as ks, coalesce(ws,[]) as ws from i left join s using (conv_id)),
 p as (select conv_id, ks, ws, unnest(range(0,len(ks)+1)) as d from c), q as (select conv_id, d, ks[1:d] as pre, case when d>0 then ws[d] else 0 end as w, len(ks)=d as last from p),
 n as (select d, pre, min(conv_id) as conv_id, count(*) as n_convs, any_value(w) as w, coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (last),'') as ends from q group by 1,2),
 ch as (select pre[1:d-1] as pre, count(*) as n_children from n where d>0 group by 1), m as (select n.*, coalesce(n_children,0) as n_children from n left join ch using (pre)),
 up as (select pre[1:a] as pre, sum(case when n_children=0 then 1 else 0 end) as n_leaves, sum((n_convs-1)*w) as saved_tokens from (select *, unnest(range(0,d+1)) as a from m) group by 1)
 select m.conv_id, m.d as depth, f.conv_id as parent_conv_id, m.n_convs, m.n_children, cast(n_leaves as bigint) as n_leaves, cast(saved_tokens as bigint) as saved_tokens, sha256(m.ends) as ends_sha256 from m join up using (pre) left join n f on m.d>0 and f.pre=m.pre[1:m.d-1]"""


def _op13(levels: int = 5, top: int = 2) -> str:
    """A step for each level: up to 16**levels documents in a source, 16**top sources."""
    one = lambda c: f"case when {c} is null then '-' else octet_length(encode(cast({c} as varchar)))||':'||cast({c} as varchar) end"
    leaf = "sha256(" + "||".join(one(c) for c in ("doc_id", "source", "lang", "n_chars")) + "||{text})"
    lower = "translate(text,'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz')"
    around = "coalesce(string_agg(h,'') over (partition by {by} order by p rows between unbounded preceding and 1 preceding),'') as lft, coalesce(string_agg(h,'') over (partition by {by} order by p rows between 1 following and unbounded following),'') as rgt"
    steps = [
        f"l as (select doc_id, source, {leaf.format(text=one('text'))} as leaf, case when {_crc32('cast(doc_id as varchar)')}%5=0 then {leaf.format(text=one(lower))} end as changed from documents)",
        "o as (select *, row_number() over (partition by source order by doc_id nulls first, leaf)-1 as rank, count(*) over (partition by source) as n, dense_rank() over (order by source nulls first)-1 as s from l)",
        "n0 as (select s, rank as p, n, leaf as h from o)",
    ]
    for k in range(1, levels + 1):
        steps.append(f"n{k} as (select s, p//16 as p, n, sha256(string_agg(h,'' order by p)) as h from n{k - 1} where n>{16 ** (k - 1)} group by s, p//16, n)")
    steps.append("t0 as (" + " union all ".join(f"select s as p, h from n{k} where n<={16**k}" + (f" and n>{16 ** (k - 1)}" if k else "") for k in range(levels + 1)) + ")")
    steps.append("many as (select count(*) as m from t0)")
    for k in range(1, top + 1):
        steps.append(f"t{k} as (select p//16 as p, sha256(string_agg(h,'' order by p)) as h from t{k - 1}, many where m>{16 ** (k - 1)} group by 1)")
    for k in range(levels):
        steps.append(f"b{k} as (select s, p, n, {around.format(by='s, p//16')} from n{k} where n>{16**k})")
    for k in range(top):
        steps.append(f"u{k} as (select p, {around.format(by='p//16')} from t{k}, many where m>{16**k})")
    steps.append("root as (" + " union all ".join(f"select h as root from t{k}, many where m<={16**k}" + (f" and m>{16 ** (k - 1)}" if k else "") for k in range(top + 1)) + ")")
    steps.append("f0 as (select o.*, root, t0.h as subroot, coalesce(changed, leaf) as f, '' as proof from o, root, t0 where t0.p=o.s)")
    last = "f0"
    for k in range(levels + top):
        table, on = (f"b{k}", f"q.s={last}.s and q.p={last}.rank//{16**k}") if k < levels else (f"u{k - levels}", f"q.p={last}.s//{16 ** (k - levels)}")
        steps.append(f"f{k + 1} as (select {last}.* exclude (f, proof), case when q.lft is null then f else sha256(q.lft||f||q.rgt) end as f, proof||coalesce(q.lft||q.rgt,'') as proof from {last} left join {table} q on {on})")
        last = f"f{k + 1}"
    return f"with {', '.join(steps)} select doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, f as folded_root, f=root as verified from {last}"


_SQL_PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]", "iban": r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}\b"}
_LUHN = "list_sum(list_transform(range(1, len(d)+1), lambda i: case when i%2=1 then cast(d[len(d)-i+1] as int) else cast(d[len(d)-i+1] as int)*2 - case when cast(d[len(d)-i+1] as int)>4 then 9 else 0 end end))%10=0"
_VALID = {
    "email": "true",
    "ip": rf"regexp_full_match(v, '{PART}(?:\.{PART}){{3}}')",
    "card": f"case when len(d) between 14 and 19 then {_LUHN} else false end",
    "phone": "len(d) between 10 and 15",
    "iban": "case when len(a) between 15 and 34 then list_reduce(list_transform(string_split(a[5:]||a[:4],''), lambda c: case when c between '0' and '9' then cast(ascii(c)-48 as hugeint) else cast(ascii(c)-55 as hugeint) end), lambda x, y: case when y>9 then (x*100+y)%97 else (x*10+y)%97 end, cast(0 as hugeint))=1 else false end",
}


def _score(kind: str) -> str:
    base, words = SCORES[kind]
    near = f"translate(substr(t, cast(greatest(1, s+1-{CONTEXT}) as bigint), cast(least({CONTEXT}, s) as bigint)),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz')"
    return f"{round(100 * base)}+case when regexp_matches({near}, '{nearby(words)}') then {round(100 * BONUS)} else 0 end"


def _op3() -> str:
    parts = []
    for rank, (kind, pattern) in enumerate(_SQL_PATTERNS.items()):
        parts.append(
            f"select doc_id, {rank} as rank, '{kind}' as kind, s as start, s+len(v) as stop, v, {_score(kind)} as score, regexp_replace(v,'[^0-9]','','g') as d, replace(v,' ','') as a, {_VALID[kind]} as ok from (select doc_id, t, m[i] as v, coalesce(list_sum(list_transform(g[1:i], lambda x: len(x))),0)+coalesce(list_sum(list_transform(m[1:i-1], lambda x: len(x))),0) as s "
            f"from (select doc_id, t, m, g, unnest(range(1, len(m)+1)) as i from (select doc_id, coalesce(text,'') as t, regexp_extract_all(coalesce(text,''), '{pattern}') as m, string_split_regex(coalesce(text,''), '{pattern}') as g from documents)))"
        )
    spans = " union all ".join(parts)
    joined = lambda where: f"coalesce(string_agg(kind||':'||cast(start as bigint)||':'||cast(stop as bigint), ',' order by start, rank, stop){where},'')"
    counts = ", ".join(f"count(*) filter (kind='{k}') as n_{k}" for k in ("email", "ip", "card", "phone"))
    return f"with p as ({spans}), k as (select * from p where ok) select d.doc_id, {counts}, sha256({joined(' filter (rank<4)')}) as base_sha256, {joined('')} as spans, coalesce(string_agg(cast(score as varchar), ',' order by start, rank, stop),'') as scores from documents d left join k on k.doc_id=d.doc_id group by d.doc_id"


ORACLE_SQL = {"op2_minhash_dedup": OP2, "op3_pii_spans": _op3(), "op7_exact_top_k": OP7, "op8_mix_sources": OP8, "op11_prefix_trie": _op11(), "op12_quality_rules": _op12(), "op13_merkle_manifest": _op13()}
