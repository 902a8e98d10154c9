"""DuckDB statements that are too long to stand beside their queries."""

from __future__ import annotations

#: Table of the reflected CRC-32 polynomial, made from its rule, and the checksum of a text's UTF-8 bytes.
CRC_TABLE = """
    bit(n, i, c) as (
        select r.n, 0, r.n::bigint from range(256) as r(n)
        union all select n, i + 1, case when c & 1 = 1 then xor(3988292384::bigint, c >> 1) else c >> 1 end from bit where i < 8
    ), crc_table as (select list(c order by n) as tab from bit where i = 8)"""


def crc(text: str) -> str:
    """The unsigned CRC-32 of the text expression, where ``crc_table`` is joined."""
    each = f"list_transform(range(0, strlen({text})), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::bigint)"
    return f"xor(4294967295::bigint, list_reduce(list_prepend(4294967295::bigint, {each}), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])))"


def resampling(buckets: int, least_words: int, percent: int, seed: int) -> str:
    split = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
    with recursive {CRC_TABLE},
    corpus as (select row_number() over () as row, doc_id, {split} as words from documents),
    wanted as (select unnest({split}) as word from benchmark),
    own as (select row, unnest(words) as word from corpus),
    hashed as (select word, {crc("word")} % {buckets} as bucket from (select word from own union select word from wanted), crc_table),
    s as (select bucket, count(*) as s from own join hashed using (word) group by 1),
    t as (select bucket, count(*) as t from wanted join hashed using (word) group by 1),
    total as (select (select coalesce(sum(s), 0) from s)::bigint as s_all, (select coalesce(sum(t), 0) from t)::bigint as t_all),
    gain as (
        select bucket, floor(1000 * ln(((coalesce(t, 0) + 1) * (s_all + {buckets}))::double / ((s + 1) * (t_all + {buckets}))::double))::bigint as gain
        from s left join t using (bucket), total
    ), weighed as (select row, count(*) as n, sum(gain)::bigint as total from own join hashed using (word) join gain using (bucket) group by 1),
    scored as (
        select row, doc_id, coalesce(n, 0) as n_features, coalesce((total - ((total % n) + n) % n) // n, 0)::bigint as weight,
               floor(-1000 * ln(-ln((('0x' || substr(sha256('{seed}:' || doc_id), 1, 8))::bigint + 0.5) / 4294967296.0)))::bigint as noise
        from corpus left join weighed using (row)
    ), placed as (
        select row, row_number() over (order by weight + noise desc, doc_id) as place, count(*) over () as n_all from scored where n_features >= {least_words}
    )
    select doc_id, n_features, weight, weight + noise as score, case when place <= {percent} * n_all // 100 then place end as rank
    from scored left join placed using (row)
    """


def prefix_trie(block: int, heads: int) -> str:
    return f"""
    with recursive {CRC_TABLE},
    turns as (
        select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
               row_number() over (partition by conv_id order by turn nulls first) as place
        from conversations where conv_id is not null
    ), convs as (select c.conv_id, {crc("c.conv_id::varchar")} % {heads} as h from (select distinct conv_id from turns) as c, crc_table),
    rebuilt as (
        select c.conv_id, t.place, t.role, t.text from convs as c join turns as t on t.conv_id = c.conv_id - c.conv_id % {block} and t.place <= c.h
        union all
        select c.conv_id, t.place, t.role, t.text from convs as c join turns as t on t.conv_id = c.conv_id and t.place > c.h
    ), dense as (select conv_id, role, text, row_number() over (partition by conv_id order by place) as depth from rebuilt),
    own as (
        select conv_id, depth, length(text) as points,
               sha256(string_agg(sha256(role) || sha256(text), '' order by depth) over (partition by conv_id order by depth)) as prefix
        from (select conv_id, depth, role, text from dense)
        union all select conv_id, 0, 0, '' from convs
    ), node as (select depth, prefix, min(conv_id) as conv_id, count(*) as n_convs, any_value(points) as points from own group by 1, 2),
    tree as (
        select n.depth, n.prefix, n.conv_id, n.n_convs, n.points, p.conv_id as parent_conv_id, p.prefix as up
        from node as n left join own as o on o.conv_id = n.conv_id and o.depth = n.depth - 1 left join node as p on p.depth = o.depth and p.prefix = o.prefix
    ), child as (select depth - 1 as depth, up as prefix, count(*) as n_children from tree where depth > 0 group by 1, 2),
    ended as (
        select depth, prefix, string_agg(conv_id::varchar, ',' order by conv_id) as ends
        from (select *, max(depth) over (partition by conv_id) as longest from own) where depth = longest group by 1, 2
    ), above as (
        select o.depth, o.prefix, count(*) filter (where c.n_children is null) as n_leaves, sum((t.n_convs - 1) * t.points)::bigint as saved_tokens
        from tree as t join own as o on o.conv_id = t.conv_id and o.depth <= t.depth left join child as c on c.depth = t.depth and c.prefix = t.prefix
        group by 1, 2
    )
    select t.conv_id, t.depth, t.parent_conv_id, t.n_convs, coalesce(c.n_children, 0) as n_children, a.n_leaves, a.saved_tokens,
           sha256(coalesce(e.ends, '')) as ends_sha256
    from tree as t join above as a using (depth, prefix) left join child as c using (depth, prefix) left join ended as e using (depth, prefix)
    """
