"""SQL equivalents of the queries that SQL can express."""

from __future__ import annotations

from chronopanel.llm import centroids, chat, prefix_trie, quality_rules, secrets, warc


def _kind_sql(rank: int, rule: secrets.Rule) -> str:
    pattern, group, least = rule.regex.replace("'", "''"), rule.group, rule.least
    before = ""
    if pattern.startswith("(?<!["):  # not in DuckDB's regexes: the character before is part of the match here
        held_back, own = pattern[4:].split(")", 1)
        pattern, group = f"(?:^|[^{held_back[1:-1]}])({own})", 1
        before = " + length(found[k]) - length(held[k])"
    size = "length(held[k])" if before else "length(found[k])"
    return f"""select doc_id, '{rule.kind}' as kind, {rank} as ord, cast(coalesce(list_sum(list_transform(gaps[1:k], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(found[1:k - 1], lambda x: length(x))), 0){before} as bigint) as start, {size} as size, length(held[k]) as held
 from (select doc_id, gaps, found, held, unnest(range(1, len(found) + 1)) as k from (select doc_id, string_split_regex(t, '{pattern}') as gaps, regexp_extract_all(t, '{pattern}', 0) as found, regexp_extract_all(t, '{pattern}', {group}) as held from texts)) where length(held[k]) >= {least}"""


def secrets_sql() -> str:
    base = ", ".join(f"'{r.kind}'" for r in secrets.BASE)
    counts = ", ".join(f"count(*) filter (where kind = '{r.kind}') as n_{r.kind}" for r in secrets.BASE)
    return f"""with texts as (select doc_id, coalesce(text, '') as t from documents), spans as ({" union all ".join(_kind_sql(i, r) for i, r in enumerate(secrets.RULES))}),
 named as (select *, kind || ':' || start || ':' || (start + size) as name from spans)
 select t.doc_id, {counts}, sha256(coalesce(string_agg(name, ',' order by start, ord) filter (where kind in ({base})), '')) as base_sha256, coalesce(string_agg(name, ',' order by start, ord), '') as spans
 from texts t left join named n using (doc_id) group by t.doc_id"""


def rules_sql() -> str:
    q = lambda s: s.replace("'", "''")
    passes = f"""regexp_matches(x, '{q(quality_rules.SENTENCE_END)}') and length(x) - length(regexp_replace(x, '{quality_rules.MARKS}', '', 'g')) <= 0.05 * length(x)
 and (len(regexp_extract_all(x, '{quality_rules.SEPARATOR}')) < 3 or len(regexp_extract_all(x, '{quality_rules.SEPARATOR}')) * 6 < length(x) - length(replace(x, ' ', '')) + 1)
 and (length(x) - length(replace(x, ' ', '')) + 1 > 20 or not regexp_matches(x, '{quality_rules.PHRASES}'))"""
    total = lambda c: f"coalesce(list_sum(list_transform({c}, lambda x: length(x))), 0)"
    return f"""with d as (select doc_id, t, list_filter(string_split_regex(t, '{quality_rules.BLANKS}'), lambda x: x <> '') as ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as ls from (select doc_id, coalesce(text, '') as t from documents)),
 win as (select doc_id, i, count(*) over (partition by doc_id, ws[i], ws[i + 1], ws[i + 2]) as n from (select doc_id, ws, unnest(range(1, len(ws) - 1)) as i from d)),
 cov as (select doc_id, count(distinct p) as n_repeat_words from (select doc_id, unnest([i, i + 1, i + 2]) as p from win where n > 1) group by 1),
 m as (select doc_id, len(ws) as n_words, cast({total("ws")} as bigint) as word_chars, length(t) - length(regexp_replace(t, '{quality_rules.SYMBOLS}', '', 'g')) as n_symbols, len(ls) - len(list_distinct(ls)) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words,
 coalesce(1 - {total(f"list_filter(ls, lambda x: {passes})")} / nullif({total("ls")}, 0), 0) as lost from d left join cov using (doc_id)),
 b as (select *, n_words < {quality_rules.LEAST_WORDS} or 100 * n_repeat_words > 50 * n_words as base_failed from m)
 select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and lost <= 0.3 as kept, round(lost, 6) as lost from b"""


def warc_sql() -> str:
    return f"""with p as (select page_id, octet_length(encode(coalesce(html, ''))) as size, sha1(coalesce(html, '')) as digest from pages),
 g as (select digest, max(page_id) as latest from p where size >= {warc.LEAST} group by 1),
 m as (select p.*, latest, latest is not null and page_id is distinct from latest as again from p left join g on p.digest = g.digest and size >= {warc.LEAST})
 select page_id, size as payload_bytes, digest as payload_digest, case when again then 'revisit' else 'response' end as record_type, case when again then latest end as refers_to, cast(null as varchar) as problem from m"""


def chat_sql() -> str:
    return f"""with r as (select distinct conv_id as conv, turn, role, text from conversations where conv_id is not null),
 p as (select *, row_number() over (partition by conv order by turn nulls first, role nulls first, text nulls first) as place from r),
 c as (select conv, count(*) as n, list(row(place, role, text) order by place) as turns from p group by 1),
 d as (select turns, n, min(conv) as conv, count(*) as n_copies from c group by 1, 2),
 kept as (select * from d anti join (select distinct turns[1:k] as head from (select turns, unnest(range(1, n)) as k from c)) on turns = head)
 select conv as conv_id, cast((place - 1) // {chat.BLOCK_TURNS} as int) as part, n as n_turns, n_copies,
 string_agg('{chat.START}' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '{chat.END}' || chr(10), '' order by place) as rendered
 from p join kept using (conv) group by conv, part, n, n_copies"""


def centroids_sql() -> str:
    far = "cast(list_sum(list_transform(list_zip(v.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as bigint)"
    steps = [
        f"""v as (select vec_id, list_transform(embedding, lambda x: cast(floor({centroids.SCALE} * cast(x as double)) as bigint)) as e from embeddings
 where len(embedding) = {centroids.DIMS} and len(list_filter(embedding, lambda x: isfinite(x))) = {centroids.DIMS})""",
        f"c0 as (select row_number() over (order by sha256('1:' || vec_id)) - 1 as k, e from v qualify k < {centroids.CENTROIDS})",
    ]
    for i in range(centroids.ROUNDS + 1):
        steps.append(f"a{i} as (select vec_id, any_value(e) as e, min(row(d, k)) as best from (select v.vec_id, v.e, c.k, {far} as d from v, c{i} c) group by vec_id)")
        if i < centroids.ROUNDS:
            steps += [
                f"m{i} as (select best[2] as k, d, sum(e[d]) as s, count(*) as n from a{i}, range(1, {centroids.DIMS + 1}) r(d) group by 1, 2)",
                f"""c{i + 1} as (select c.k, coalesce(m.e, c.e) as e from c{i} c left join
 (select k, list(cast((s - ((s % n) + n) % n) // n as bigint) order by d) as e from m{i} group by k) m using (k))""",
            ]
    last = centroids.ROUNDS
    return f"""with {", ".join(steps)} select vec_id, cast(best[2] as int) as cluster, best[1] as distance, cast(sum(best[1]) over (partition by best[2]) as bigint) as cluster_inertia,
 cast(sum(best[1]) over () as bigint) as inertia, sha256(array_to_string(c.e, ',')) as centroid_sha256 from a{last} join c{last} c on c.k = best[2]"""


def trie_sql() -> str:
    octets = "list_transform(string_split(conv::varchar, ''), lambda x: ascii(x)::bigint)"
    of_byte = "list_reduce(list_concat([xor(a, b) & 255], [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    crc = f"xor(list_reduce(list_concat([4294967295], {octets}), lambda a, b: xor(a >> 8, {of_byte})), 4294967295)"
    return f"""with said as (select conv_id as conv, turn, coalesce(role, '') as r, coalesce(text, '') as t from conversations where conv_id is not null),
 hashed as (select conv, turn, sha256(octet_length(encode(r)) || ':' || r || t)[1:32] as sym, octet_length(encode(t)) as size from said),
 placed as (select conv, sym, size, row_number() over (partition by conv order by turn nulls first, sym) as n from hashed),
 convs as (select conv as c, conv - conv % {prefix_trie.FAMILY} as p, {crc} % {prefix_trie.HEADS} as h from (select distinct conv from placed)),
 parts as (select c, 0 as which, n, sym, size from convs join placed on conv = p and n <= h union all select c, 1, n, sym, size from convs join placed on conv = c and n > h),
 seqs as (select c, coalesce(list(sym order by which, n) filter (where sym is not null), []) as syms, coalesce(list(size order by which, n) filter (where sym is not null), []) as sizes from convs left join parts using (c) group by c),
 members as (select c, d, array_to_string(syms[1:d], '') as node, array_to_string(syms[1:greatest(d - 1, 0)], '') as above, coalesce(sizes[d], 0) as size, d = len(syms) as ended from seqs, unnest(range(0, len(syms) + 1)) as u(d)),
 nodes as (select node, above, d, size, min(c) as conv_id, count(*) as n, coalesce(string_agg(c::varchar, ',' order by c) filter (where ended), '') as ends from members group by 1, 2, 3, 4),
 kids as (select above, count(*) as k from nodes where d > 0 group by 1),
 paths as (select m.node as v, u.node, u.n, u.size, kids.k from nodes u, unnest(range(0, u.d + 1)) as w(e), nodes m left join kids on kids.above = u.node where m.node = u.node[1:32 * e]),
 sums as (select v, count(*) filter (where k is null) as n_leaves, sum((n - 1) * size) as saved from paths group by 1)
 select o.conv_id, o.d as depth, case when o.d > 0 then q.conv_id end as parent_conv_id, o.n as n_convs, coalesce(kids.k, 0) as n_children, n_leaves, cast(saved as bigint) as saved_tokens, sha256(o.ends) as ends_sha256
 from nodes o join nodes q on q.node = o.above left join kids on kids.above = o.node join sums on sums.v = o.node"""
