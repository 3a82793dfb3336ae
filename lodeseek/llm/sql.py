"""DuckDB SQL for the llm queries that SQL can express over whole tables."""

from __future__ import annotations

_RANKS = """
with m as (select distinct query_id, match_id, try_cast(similarity as double) a, try_cast(score as double) b from search_matches where match_id is not null),
r as (select query_id, match_id, count(*) over w n,
        rank() over (partition by query_id order by a nulls first) + (count(*) over (partition by query_id, a) - 1) / 2 ra,
        rank() over (partition by query_id order by b nulls first) + (count(*) over (partition by query_id, b) - 1) / 2 rb
      from m window w as (partition by query_id)),
s as (select query_id, match_id, case when n > 1 then (ra - 1) / (n - 1) else 1.0 end x, case when n > 1 then (rb - 1) / (n - 1) else 1.0 end y from r),
p as (select *, round(x * sqrt(0.5) + y * sqrt(0.5), 12) projection from s),
o as (select *, row_number() over (partition by query_id order by projection desc, greatest(x, y) desc, match_id) place from p)
"""

_TERMS = """
with c as (select distinct id, identifiers, coalesce(chunk_text, '') t from chunks where id is not null and identifiers is not null),
terms as (select distinct id, unnest(regexp_split_to_array(trim(identifiers), '\\s+')) term from c),
df as (select term, count(*) df from terms where term <> '' group by term),
words as (select id, unnest(regexp_extract_all(t, '[A-Za-z0-9_$]+')) term from c),
tf as (select id, term, count(*) tf from words group by id, term)
"""


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# Letters that look like a Latin one, by code point; stated anew here, so that the operator's table is checked.
_ALIKE = {
    "a": "430", "c": "441 3f2 2ca5", "d": "501", "e": "435", "g": "261 581", "h": "4bb 570", "i": "456", "j": "458 3f3", "l": "4cf", "n": "578", "o": "43e 3bf 585 2c9f", "p": "440 2ca3", "q": "51b", "s": "455", "v": "3bd", "w": "51d", "x": "445 2cad", "y": "443",
    "A": "410 391 13aa a4ee", "B": "412 392 2c82 13f4 a4d0", "C": "421 3f9 2ca4 13df a4da", "D": "13a0 a4d3", "E": "415 395 13ac a4f0", "F": "a4dd", "G": "50c 13c0 a4d6", "H": "41d 397 2c8e 13bb a4e7", "I": "406 399 2c92 a4f2", "J": "408 37f 13ab a4d9", "K": "41a 39a 2c94 13e6 a4d7", "L": "13de a4e1",
    "M": "41c 39c 2c98 13b7 a4df", "N": "39d 2c9a a4e0", "O": "41e 39f 555 2c9e a4f3", "P": "420 3a1 2ca2 13e2 a4d1", "Q": "51a", "R": "13a1 a4e3", "S": "405 13da a4e2", "T": "422 3a4 2ca6 13a2 a4d4", "U": "54d a4f4", "V": "13d9 a4e6", "W": "51c 13b3 a4ea", "X": "425 3a7 2cac a4eb", "Y": "423 4ae 3a5 2ca8 a4ec", "Z": "396 13c3 a4dc",
    "-": "2010 2011",
}
_GONE = "ad 34f 61c 180e 200b 200e 200f 2060 2061 2062 2063 2064 feff"


def _fold_sql(text: str) -> str:
    """The one form in SQL: full-width ASCII and look-alike letters by translate, blanks and invisible signs by expression, then NFC."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
    plain = "".join(chr(c) for c in range(0x21, 0x7F))
    pairs = [(chr(int(c, 16)), latin) for latin, codes in _ALIKE.items() for c in codes.split()]
    gone = "".join(f"\\x{{{c}}}" for c in _GONE.split())
    e = f"nfc_normalize({text})"
    e = f"translate({e}, {_lit(wide + ''.join(a for a, _ in pairs))}, {_lit(plain + ''.join(b for _, b in pairs))})"
    e = f"regexp_replace({e}, '[\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]', ' ', 'g')"
    e = f"regexp_replace({e}, '[{gone}\\x{{fe00}}-\\x{{fe0d}}\\x{{e0100}}-\\x{{e01ef}}]', '', 'g')"
    e = f"regexp_replace({e}, '([\\x00-\\x{{5ff}}])[\\x{{200c}}\\x{{200d}}]', '\\1', 'g')"
    e = f"replace(replace(replace({e}, 'ﬁ', 'fi'), 'ﬂ', 'fl'), chr(13) || chr(10), chr(10))"
    return f"nfc_normalize({e})"


def _words_sql(text: str) -> str:
    """The words of a text after folding, without case and punctuation; Chinese and Japanese signs are words by themselves."""
    return f"regexp_extract_all(lower({_fold_sql(text)}), '[\\x{{3040}}-\\x{{30ff}}\\x{{3400}}-\\x{{4dbf}}\\x{{4e00}}-\\x{{9fff}}]|[\\p{{Latin}}\\p{{Cyrillic}}\\p{{Greek}}\\p{{Hangul}}\\p{{N}}ªºµʰ-ˁ]+')"


# Three scores; the first principal component as the dominant row of the correlation matrix's 2^30th power.
_THREE = """
with recursive m as (select distinct query_id, match_id, try_cast(similarity as double) a, try_cast(score as double) b, -(try_cast(split_part(lines, '-', 2) as int) - try_cast(split_part(lines, '-', 1) as int) + 1) c from search_matches where match_id is not null),
r as (select query_id, match_id, count(*) over w n,
        rank() over (partition by query_id order by a nulls first) + (count(*) over (partition by query_id, a) - 1) / 2 ra,
        rank() over (partition by query_id order by b nulls first) + (count(*) over (partition by query_id, b) - 1) / 2 rb,
        rank() over (partition by query_id order by c nulls first) + (count(*) over (partition by query_id, c) - 1) / 2 rc
      from m window w as (partition by query_id)),
s as (select query_id, match_id, case when n > 1 then (ra - 1) / (n - 1) else 1.0 end x, case when n > 1 then (rb - 1) / (n - 1) else 1.0 end y, case when n > 1 then (rc - 1) / (n - 1) else 1.0 end z from r),
power(k, a, b, c, d, e, f) as (
  select 0, 1.0::double, corr(x, y), corr(x, z), 1.0::double, corr(y, z), 1.0::double from s
  union all
  select k + 1, (a * a + b * b + c * c) / t, (a * b + b * d + c * e) / t, (a * c + b * e + c * f) / t, (b * b + d * d + e * e) / t, (b * c + d * e + e * f) / t, (c * c + e * e + f * f) / t
  from (select *, a * a + 2 * b * b + 2 * c * c + d * d + 2 * e * e + f * f t from power) where k < 30),
top as (select case when a >= d and a >= f then [a, b, c] when d >= f then [b, d, e] else [c, e, f] end v from power where k = 30),
w as (select list_transform(v, lambda q: q / sqrt(list_sum(list_transform(v, lambda u: u * u))) * case when list_sum(v) >= 0 then 1 else -1 end) w from top)
"""


SQL = {
    "p1_found": _RANKS + "select query_id, match_id from o where place = 1",
    "p1_ranking": _RANKS + "select query_id, match_id, x as rank_0, y as rank_1, projection, cast(place as integer) as place from o",
    "p1_loadings": _THREE + "select unnest(['similarity', 'score', 'span']) as score, unnest([1, 1, -1]) as direction, unnest(list_transform(w, lambda q: round(q, 6))) as loading, unnest(list_transform(w, lambda q: q >= 0)) as agrees from w",
    "p1_three": _THREE
    + """, p as (select query_id, match_id, x, y, z, round(x * abs(w[1]) + y * abs(w[2]) + z * abs(w[3]), 12) projection from s, w)
select query_id, match_id, round(projection, 6) as projection, cast(row_number() over (partition by query_id order by projection desc, greatest(x, y, z) desc, match_id) as integer) as place from p""",
    "p2_layout": """
with c as (select distinct file_path, coalesce(chunk_text, '') t from chunks where file_path is not null),
l as (select file_path, t, unnest(string_split(t, chr(10))) line from c)
select c.file_path, cast(sum(length(t)) as bigint) as chars, cast(sum(case when t = '' then 0 else len(string_split(t, chr(10))) - case when ends_with(t, chr(10)) then 1 else 0 end end) as bigint) as lines,
  (select max(length(line)) from l where l.file_path = c.file_path) as max_line, cast(sum(length(regexp_replace(t, '[^0-9]', '', 'g'))) as bigint) as digits
from c group by c.file_path
""",
    "p4_properties": "select distinct id, true as short_enough, true as from_start, true as whole_with_overlap, true as same_text, true as true_lines from chunks where length(chunk_text) > 2048",
    "p4_found": "select distinct id from chunks where length(chunk_text) > 2048",
    "p5_found": """
with v as (select distinct id, cast(embedding as double[]) e from chunks where id is not null and embedding is not null),
u as (select id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) e from v where list_sum(list_transform(e, lambda y: abs(y))) > 0),
p as (select a.id a, b.id b, list_inner_product(a.e, b.e) c from u a, u b where a.id <> b.id),
r as (select *, row_number() over (partition by a order by c desc, b) place from p where c >= 0.9)
select distinct least(a, b) as id_a, greatest(a, b) as id_b from r where place <= 5
""",
    "p5_recall": "select 5 * count(distinct id) as neighbours, true as found from chunks where id % 50 = 0 and list_sum(list_transform(cast(embedding as double[]), lambda x: abs(x))) > 0",
    "p6_found": _TERMS + "select t.id, t.term from terms t join df on df.term = t.term join tf on tf.id = t.id and tf.term = t.term where df between 2 and 5 and tf >= 3",
    "p6_scores": _TERMS.replace("with c as", "with recursive c as")
    + """, t as (select t.id, t.term, coalesce(tf, 0)::double tf, df from terms t join df using (term) left join tf using (id, term) where t.term <> ''),
cf as (select term, sum(tf) cf from t group by term), whole as (select sum(tf) n from t),
b as (select t.*, cf, cf / n bg, sum(tf) over (partition by id) own from t join cf using (term), whole),
em(k, id, term, bg, tf, p, moving) as (
  select 0, id, term, bg, tf, case when own > 0 then tf / own else 0 end, true from b
  union all
  select k + 1, id, term, bg, tf, new, max(abs(new - p)) over (partition by id) >= 1e-7
  from (select k, id, term, bg, tf, p, e / greatest(sum(e) over (partition by id), 1e-300) new
    from (select *, tf * (0.1 * p) / (0.9 * bg + 0.1 * p + 1e-300) e from em where moving and k < 500))),
last as (select id, term, arg_max(p, k) p, max(k) k, bool_or(not moving) done from em group by id, term)
select b.id, b.term, cast(b.tf as integer) as tf, df, cast(cf as bigint) as cf, round(p, 6) as score, cast(case when done then k else -1 end as integer) as rounds from b join last using (id, term)""",
    "p7_kept": "select distinct id, true as same_length, true as same_line_ends, true as rest_untouched, true as none_left from chunks where chunk_text is not null",
    "p8_runs": f"""
with d as (select doc_id, ' ' || array_to_string(w, ' ') || ' ' t from (select doc_id, {_words_sql("text")} w from documents where doc_id is not null and text is not null)),
i as (select distinct item_id, {_words_sql("item_text")} w from eval_items where item_text is not null and item_id is not null),
r as (select distinct item_id, ' ' || array_to_string(w[k:k + least(len(w), 15) - 1], ' ') || ' ' run from (select *, unnest(range(1, greatest(len(w) - 14, 1) + 1)) k from i where len(w) > 0))
select distinct doc_id, item_id from d join r on contains(t, run)
""",
    "p9_plan": """
with d as (select distinct doc_id, regexp_replace(lower(trim(source)), '[\\s-]+', '_', 'g') s, length(text) n from documents where doc_id is not null),
h as (select s, sum(n) n, count(*) c from d group by s), t as (select sum(n) n from (select distinct doc_id, n from d))
select m.source, coalesce(h.c, 0) as documents, round(m.target_share * t.n, 3) as target_chars, cast(coalesce(h.n, 0) as bigint) as available_chars, cast(coalesce(h.n, 0) * m.max_repeats as bigint) as capacity_chars,
  round(least(coalesce(h.n, 0) * m.max_repeats, m.target_share * t.n), 3) as planned_chars, coalesce(h.n, 0) * m.max_repeats < m.target_share * t.n as short
from mix_targets m left join h on h.s = m.source cross join t
""",
    "p9_kept": "select source, true as within_repeats, true as as_planned from mix_targets",
    "p10_folded": f"with f as (select distinct doc_id, {_fold_sql('text')} form from documents where doc_id is not null) select doc_id, cast(length(form) as integer) as folded_chars, sha256(form) as folded_sha from f",
    "p10_classes": f"""
with f as (select distinct doc_id, md5(text) raw, md5({_fold_sql("text")}) form from documents where doc_id is not null and text is not null),
t as (select form, raw, count(*) n from f group by form, raw), c as (select form, min(doc_id) class_id, count(*) members, count(distinct raw) texts from f group by form)
select doc_id, class_id, members, texts, members - n as links from f join t using (form, raw) join c using (form)
""",
    "p9_found": """
with d as (select distinct doc_id, regexp_replace(lower(trim(source)), '[\\s-]+', '_', 'g') s, length(text) n from documents where doc_id is not null),
h as (select s, sum(n) n from d group by s), t as (select sum(n) n from (select distinct doc_id, n from d))
select m.source from mix_targets m left join h on h.s = m.source cross join t
where coalesce(h.n, 0) * m.max_repeats < m.target_share * t.n
""",
    "p10_found": f"""
with f as (select distinct doc_id, text, md5({_fold_sql("text")}) form from documents where doc_id is not null and text is not null)
select distinct a.doc_id as doc_id_a, b.doc_id as doc_id_b from f a join f b on a.form = b.form and a.doc_id < b.doc_id and a.text <> b.text
""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
