"""DuckDB SQL for the corpus queries that SQL can express.

Ranking, hash tree, language model, SimHash, raking and packing have none: their tests hold them
against brute force.
"""

# The measures and failure bits of every document.
_LEDGER = r"""
        with d as (
            select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words,
                   list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
            from documents
        ), windows as (
            select doc_id, unnest(range(1, len(words) - 6)) as i,
                   unnest(list_transform(range(1, len(words) - 6), lambda i: array_to_string(words[i:i + 7], ' '))) as w
            from d where len(words) >= 8
        ), twice as (
            select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, w) as n from windows) where n > 1
        ), covered as (
            select doc_id, count(distinct i + j) as n from twice, range(8) r(j) group by doc_id
        ), m as (
            select d.doc_id, len(words) as n_words,
                   length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) as word_chars,
                   length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as n_symbols,
                   len(lines) as n_lines,
                   len(lines) - len(list_distinct(lines)) as n_dup_lines,
                   len(list_filter(range(2, len(words) + 1), lambda i: words[i] = words[i - 1])) as n_adjacent,
                   len(list_distinct(words)) as n_distinct,
                   length(regexp_replace(t, '[^A-Z]', '', 'g')) as n_capitals,
                   length(regexp_replace(t, '[^!]', '', 'g')) as n_exclaims,
                   length(regexp_replace(t, '[^0-9]', '', 'g')) as n_digits,
                   length(regexp_replace(t, '[^.?,]', '', 'g')) as n_stops,
                   coalesce(c.n, 0) as n_repeat_words
            from d left join covered c on d.doc_id = c.doc_id
        ), b as (
            select *, (case when n_words < 20 then 1 else 0 end)
                    + (case when 100 * n_repeat_words > 30 * n_words then 2 else 0 end)
                    + (case when 10 * n_symbols > n_words then 4 else 0 end)
                    + (case when 100 * n_adjacent > 40 * n_words then 8 else 0 end)
                    + (case when 100 * n_capitals > 45 * word_chars then 16 else 0 end)
                    + (case when 4 * n_exclaims > n_words then 32 else 0 end)
                    + (case when 2 * n_dup_lines > n_lines then 64 else 0 end)
                    + (case when word_chars < 2 * n_words or word_chars > 15 * n_words then 128 else 0 end) as fail_bits
            from m
        )
"""

ORACLES = {
    "op3_exact_dedup": r"""
        with d as (
            select doc_id, length(coalesce(text, '')) as points,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as norm
            from documents
        ), g as (
            select doc_id, norm, count(*) over (partition by norm) as group_size,
                   first_value(doc_id) over (partition by norm order by points desc, doc_id) as keep_id
            from d
        )
        select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(norm) as text_sha256 from g
    """,
    "op4_quality_rules": _LEDGER + r"""
        select doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_adjacent, n_distinct, n_capitals, n_exclaims,
               n_digits, n_stops, n_repeat_words, cast(fail_bits as bigint) as fail_bits,
               fail_bits & 3 <> 0 as base_failed, fail_bits = 0 as kept,
               fail_bits & 3 = 0 as kept_v1, fail_bits & 127 = 0 as kept_v2, fail_bits & 255 = 0 as kept_v3
        from b
    """,
    "rule_ablations": _LEDGER + r""", rules(version, rule, bit, mask) as (
            select version, names[i], 1 << (i - 1), mask
            from (values ('v1', 2, 3), ('v2', 7, 127), ('v3', 8, 255)) v(version, n, mask),
                 (select ['few_words', 'repeated_windows', 'symbols', 'stutter', 'capitals', 'exclamations', 'duplicate_lines',
                          'word_length'] as names), range(1, 9) r(i)
            where i <= n
        )
        select version, rule, cast(count(*) filter (fail_bits & bit <> 0) as bigint) as failed,
               cast(count(*) filter (fail_bits & mask = bit) as bigint) as rejected_by_it_alone
        from b, rules group by version, rule
    """,
    "op6_warc": r"""
        with p as (select page_id, encode(coalesce(html, '')) as b from pages),
        q as (select page_id, octet_length(b) as n, sha1(b) as d, max(page_id) over (partition by sha1(b)) as latest from p)
        select page_id, n as payload_bytes, d as payload_digest,
               case when n >= 1000 and page_id < latest then 'revisit' else 'response' end as record_type,
               case when n >= 1000 and page_id < latest then latest end as refers_to
        from q
    """,
    "op8_line_dedup": r"""
        with lines as (
            select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
                   generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
            from documents
        ), keyed as (
            select *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
            from lines
        ), frequent as (
            select key, max(doc_id) as keeper from keyed where length(key) >= 20 group by key having count(distinct doc_id) >= 3
        ), judged as (
            select k.doc_id, k.pos, k.line, f.key is not null and k.doc_id <> f.keeper as gone
            from keyed k left join frequent f on k.key = f.key
        )
        select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
               sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
        from judged group by doc_id
    """,
}


def _codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Product codes with every round spelled out and every entry compared."""
    near = """
            select p.id, p.vec_id, p.label, p.part, p.v, min(struct_pack(
                d := list_sum(list_transform(range(1, len(p.v) + 1), lambda i: (p.v[i] - b.v[i]) * (p.v[i] - b.v[i]))),
                e := b.entry)) as best
            from parts p join {book} b using (part) group by all"""
    steps = [
        f"""
        with kept as (
            select row_number() over (order by vec_id, embedding) as id, vec_id, label,
                   list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v
            from embeddings
            where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ), parts as (
            select id, vec_id, label, part, v[part * len(v) // {parts} + 1 : (part + 1) * len(v) // {parts}] as v
            from kept, range({parts}) r(part)
        ), book0 as (select part, id - 1 as entry, v from parts where id <= {entries})"""
    ]
    for k in range(rounds):
        steps.append(f"""near{k} as materialized ({near.format(book=f"book{k}")}
        ), means{k} as (
            select part, best.e as entry, i, cast(floor(sum(v[i]) / count(*)) as bigint) as m
            from near{k}, range(1, (select max(len(v)) + 1 from parts)) r(i) group by all
        ), book{k + 1} as materialized (
            select part, entry, coalesce(m.v, b.v) as v
            from book{k} b left join (select part, entry, list(m order by i) as v from means{k} group by all) m using (part, entry)
        )""")
    steps.append(f"""final as materialized ({near.format(book=f"book{rounds}")}
        ), coded as (
            select id, vec_id, label, string_agg(lower(printf('%02x', best.e)), '' order by part) as code,
                   cast(sum(best.d) as bigint) as error
            from final group by all
        )
        select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error,
               (select sha256(string_agg(array_to_string(v, ','), ',' order by part, entry)) from book{rounds}) as codebooks_sha256
        from coded
    """)
    return ", ".join(steps)


ORACLES["op12_vector_codes"] = _codes_sql()
