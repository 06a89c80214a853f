"""SQL for the queries of this package that SQL can express, as DuckDB runs it on the same tables."""

# One byte step of the checksum for each of 256 values, by its rule: eight halvings with the reversed polynomial.
_CRC_TABLE = """
    select list(v order by b) as crc from (
        select b, list_reduce(list_prepend(b, range(8)), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as v
        from range(256) t(b)
    )
"""

OP11 = r"""
with docs as (
    select row_number() over () as row_no, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as words
    from documents
),
sized as (select row_no, doc_id, words, len(words)::bigint as n from docs where len(words) > 0),
whole as (select count(*)::bigint as n_docs, sum(n)::bigint as n_terms from sized),
spread as (select row_no, unnest(words) as term from sized),
freq as (select row_no, term, count(*)::bigint as tf from spread group by all),
items as (
    select distinct item_id, text from benchmark
),
asked as (
    select item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
    from items
),
wanted as (select item_id, term, count(*)::bigint as times from asked group by all),
weight as (
    select term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)))::bigint as w
    from freq, whole group by term, n_docs
),
norm as (select row_no, doc_id, 75 + ((25 * n * n_docs) // n_terms) as m from sized, whole),
scored as (
    select item_id, row_no, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::bigint as score
    from wanted join weight using (term) join freq using (term) join norm using (row_no) group by all
),
placed as (
    select item_id, doc_id, score,
        row_number() over (partition by item_id order by score desc, doc_id nulls first)::integer as rank
    from scored where score > 0
)
select item_id, rank, doc_id, score from placed where rank <= 20
"""

OP12 = r"""
with docs as (
    select doc_id, coalesce(text, '') as text, length(coalesce(text, ''))::bigint as n, sha256('1:' || doc_id::varchar) as h
    from documents
),
drawn as (
    select *, ('0x' || substr(h, 1, 8))::bigint % (n + 1) as one, ('0x' || substr(h, 9, 8))::bigint % (n + 1) as two,
        ('0x' || substr(h, 17, 8))::bigint % 100 as h3, ('0x' || substr(h, 25, 8))::bigint % 100 as h4
    from docs
),
formed as (
    select *, least(one, two) as a, greatest(one, two) as b,
        case when n = 0 or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 >= 90 then 'plain'
             when h4 < 20 then 'spm' else 'psm' end as form
    from drawn
),
parts as (
    select *, substr(text, 1, a) as p, substr(text, a + 1, b - a) as m, substr(text, b + 1, n - b) as s from formed
),
made as (
    select *, case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m
        else '<S>' || s || '<P>' || p || '<M>' || m end as output
    from parts
)
select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars,
    case when form <> 'plain' then b - a end as middle_chars, sha256(output) as output_sha256, sha256(text) as restored_sha256
from made
"""

OP13 = f"""
with tables as ({_CRC_TABLE}),
docs as (select doc_id, coalesce(text, '') as text, hex(encode(coalesce(text, ''))) as hexed from documents),
summed as (
    select doc_id, strlen(text)::bigint + 1 as size,
        xor(4294967295, list_reduce(
            list_prepend(4294967295, list_transform(range(0, length(hexed), 2), lambda i: ('0x' || substr(hexed, i + 1, 2))::bigint)),
            lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])))::bigint as text_crc32
    from docs, tables
),
placed as (
    select doc_id, size, text_crc32,
        ((coalesce(sum(size) over (order by doc_id nulls first, text_crc32 rows between unbounded preceding and 1 preceding), 0)
            * 8) // sum(size) over ())::integer as shard,
        row_number() over (order by doc_id nulls first, text_crc32) as place
    from summed
)
select doc_id, size, text_crc32, 'bytes' as law, shard, place - min(place) over (partition by shard) as slot,
    null::integer as grown_shard
from placed
"""

OP7 = r"""
with recursive docs as (
    select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x20\x09-\x0D]+'), lambda w: w <> '') as words
    from documents
),
sets as (
    select doc_id, case when len(words) >= 5 then list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i : i + 4], ' ')))
        when len(words) > 0 then [array_to_string(words, ' ')] else [] end as shingles
    from docs
),
distinct_sets as (select min(doc_id) as id, list_sort(shingles) as own, len(shingles) as n from sets where len(shingles) > 0 group by 2, 3),
spread as (select id, n, unnest(own) as shingle from distinct_sets),
shared as (
    select a.id as a, b.id as b, a.n as na, b.n as nb, count(*) as common
    from spread a join spread b on a.shingle = b.shingle and a.id < b.id and 4 * a.n >= 3 * b.n and 4 * b.n >= 3 * a.n
    group by all
),
links as (select a, b from shared where 100 * common >= 75 * (na + nb - common)),
edges as (select a, b from links union all select b, a from links),
reach as (select id, id as other from distinct_sets union select r.id, e.b from reach r join edges e on e.a = r.other),
least as (select id, min(other) as component from reach group by id)
select s.doc_id, len(s.shingles)::bigint as n_shingles, coalesce(l.component, s.doc_id) as component_id
from sets s left join distinct_sets d on len(s.shingles) > 0 and d.own = list_sort(s.shingles) left join least l on l.id = d.id
"""

CHECKS = {"op7_signature_tree": OP7, "op11_bag_dedup": OP11, "op12_wavelet_cuts": OP12, "op13_sampled_splitters": OP13}
