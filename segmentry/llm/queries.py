"""Registered queries of this folder and the SQL that checks them, where SQL can express them.

No SQL: op2 and op5 (trained classifiers: held-out accuracy), op4 (reading HTML), op6 (search for an exponent and
hash order), op9 (windows by stride), op13 (a 64-bit hash that SQL lacks) and the pipeline. ``tests/llm`` compares these with plain versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from segmentry.llm import fptree, graysim, html, language, leaks, licenses, lines, merkle, mixing, neardup, quality, search, secret_scan
from segmentry.llm.common import table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaked_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top_inner_products(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 50 == 0)


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text", "n_chars")
    mixed = mixing.mix(docs, key=["doc_id", "n_chars"])
    return mixed.select("doc_id", "source", F.col("__epoch").alias("epoch"), F.col("__mix_block").alias("mix_block"), F.col("__tokens").alias("n_tokens"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return lines.drop_boilerplate(docs).select("doc_id", "source", "text", F.col("__removed").alias("n_removed"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_digest(table(spark, sf_dir, "documents"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find_licenses(table(spark, sf_dir, "documents"), licenses.shipped_templates())


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_groups(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.prove(table(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fptree.top_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graysim.near_fingerprints(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_decontamination, op2_language, op3_exact_top_k, op4_html_text, op5_quality, op6_mixing, op7_line_dedup, op8_secrets, op9_licenses, op10_near_duplicates,
    op11_merkle_manifest, op12_ranked_search, op13_simhash_groups)}
QUERIES["pipeline"] = corpus_pipeline.run

_LETTER_WORDS = r"string_split(nullif(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')), ''), ' ')"
_ASCII_WORDS = r"string_split(nullif(trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g')), ''), ' ')"


def _places(size: int) -> str:
    """Positions (from 0) and shingles of the list ``ws`` as a list of structs."""
    return (f"case when len(ws) >= {size} then list_transform(range(1, len(ws) - {size - 2}), lambda i: {{'p': i - 1, 's': array_to_string(ws[i:i + {size - 1}], ' ')}})"
            " when len(ws) > 0 then [{'p': 0::BIGINT, 's': array_to_string(ws, ' ')}] else [] end")

_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


def _levels(source: str) -> str:
    """Recursive part: nodes (tree, level, pos, d, n) above the leaves of ``source``, where ``n`` counts the nodes of the level."""
    return (f"select tree, 0 as level, pos, d, n from {source} union all"
            " select tree, level + 1, pos // 2, sha256(string_agg(d, '' order by pos)), (n + 1) // 2 from {name} where n > 1 group by tree, level, pos // 2, n")


def _path(leaves: str, nodes: str, lift: int) -> str:
    """The siblings of each leaf from the bottom up; the digest is empty where there is none."""
    return (f"select l.tree, l.pos, c.level + {lift} as level, coalesce(s.pos < c.pos, false) as before, coalesce(s.d, '') as d from {leaves} l"
            f" join {nodes} c on c.tree = l.tree and c.pos = l.pos >> c.level and c.n > 1 left join {nodes} s on s.tree = c.tree and s.level = c.level and s.pos = xor(c.pos, 1)")


def _encoded(value: str) -> str:
    return f"coalesce(strlen(({value})::VARCHAR) || ':' || ({value})::VARCHAR, '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_encoded(v) for v in ("doc_id", "source", "lang", n_chars, "text")) + ")"


ORACLES = {
    "op1_decontamination": f"""
with every as (select min(item_id) as item_id, ws from (select item_id, {_LETTER_WORDS} as ws from benchmark where item_id is not null) where ws is not null group by ws),
items as (select * from every where len(ws) >= 5), few as (select * from every where len(ws) < 5),
runs as (select doc_id, n, unnest(list_transform(range(1, len(ws) - n + 2), lambda i: {{'p': i - 1, 's': ws[i:i + n - 1]}})) as x
 from (select doc_id, {_LETTER_WORDS} as ws from documents), (select distinct len(ws) as n from few)),
shorts as (select doc_id, item_id, 1.0::DOUBLE as similarity, min(x.p)::INTEGER as start_word, any_value(n)::INTEGER as n_words from runs join few on few.ws = x.s group by doc_id, item_id),
ip as (select item_id, len(ws) as size, unnest({_places(5)}) as x from items),
ish as (select item_id, size, x.p as o, x.s as s from ip),
dict as (select s, greatest(1000 // count(distinct item_id), 1) as w from ish group by s),
dp as (select doc_id, len(ws) as n, unnest({_places(5)}) as x from (select doc_id, {_LETTER_WORDS} as ws from documents)),
hits as (select distinct doc_id, n, x.p as pos, x.s as s, w from dp join dict on dp.x.s = dict.s),
win as (select distinct doc_id, greatest(pos - o, 0) as st, least(pos - o + size, n) as en, size from hits join ish using (s)),
inside as (select w.doc_id, st, en, size, pos, s, w from win w join hits h on h.doc_id = w.doc_id and h.pos >= st and h.pos < greatest(en - 4, st + 1)),
seen as (select distinct doc_id, st, en, size, s, w from inside),
known as (select doc_id, st, en, size, sum(w) as known from seen group by all),
cnt as (select doc_id, st, en, size, count(*) as n_in from inside group by all),
iset as (select distinct item_id, size, s from ish),
iw as (select item_id, sum(w) as weight from iset join dict using (s) group by item_id),
shared as (select doc_id, st, en, seen.size, item_id, sum(w) as shared from seen join iset on iset.s = seen.s and iset.size = seen.size group by all),
scored as (select doc_id, st, en, item_id, shared, known + (greatest(en - st - 4, 1) - n_in) * 1000 + weight - shared as u
 from shared join known using (doc_id, st, en, size) join cnt using (doc_id, st, en, size) join iw using (item_id)),
ranked as (select *, round(shared::DOUBLE / u::DOUBLE, 6) as similarity, row_number() over (partition by doc_id, item_id order by round(shared::DOUBLE / u::DOUBLE, 6) desc, st, en - st desc) as r
 from scored where 100 * shared >= 80 * u)
select doc_id, item_id, similarity, st as start_word, en - st as n_words from ranked where r = 1 union all select * from shorts
""",
    "op3_exact_top_k": """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) as v from embeddings
 where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT as score from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id)
select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::INTEGER as rank, vec_id, score from s
qualify row_number() over (partition by query_id order by score desc, vec_id) <= 5
""",
    "op7_line_dedup": """
with l as (select distinct doc_id, source, unnest(string_split(text, chr(10))) as line from documents),
c as (select source, line, count(*) as n from l where trim(line) <> '' group by all),
t as (select source, count(*) as pages from documents group by source),
b as (select source, list(line) as drops from c join t using (source) where n >= 4 and n > 0.02::DOUBLE * pages group by source),
d as (select doc_id, source, text, string_split(text, chr(10)) as ls, coalesce(drops, []) as drops from documents left join b using (source)),
k as (select *, list_filter(ls, lambda x: not list_contains(drops, x)) as stays from d)
select doc_id, source, case when len(stays) < len(ls) then array_to_string(stays, chr(10)) else text end as text, (len(ls) - len(stays))::BIGINT as n_removed from k
""",
    "op8_secrets": "with s as (" + " union all ".join(
        f"""select doc_id, {k} as kind, '{name}' as name, list_transform(range(1, len(st) + 1), lambda i: {{
 'e': list_sum(list_transform(st[1:i], lambda x: length(x)))::BIGINT, 'm': length(regexp_extract(st[i], '{pattern.replace("'", "''")}', 0)),
 'v': length(regexp_extract(st[i], '{pattern.replace("'", "''")}', {group}))}}) as found, {least} as least
 from (select doc_id, regexp_extract_all(coalesce(text, ''), '(?s).*?{pattern.replace("'", "''")}', 0) as st from documents)"""
        for k, (name, (pattern, group, least)) in enumerate(secret_scan.RULES.items())) + """),
f as (select doc_id, kind, name, unnest(found) as x, least from s),
g as (select doc_id, count(*) filter (kind = 0) as n_assign, count(*) filter (kind = 1) as n_access, count(*) filter (kind = 2) as n_hex,
 string_agg(name || ':' || (x.e - x.m) || ':' || x.e, ',' order by x.e - x.m, kind) as spans from f where x.v >= least group by doc_id)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(spans, '')) as base_sha256, coalesce(spans, '') as spans
from documents left join g using (doc_id)
""",
    "op10_near_duplicates": f"""
with recursive sh as (select distinct doc_id, x.s as s from (select doc_id, unnest({_places(4)}) as x from (select doc_id, {_ASCII_WORDS} as ws from documents))),
n as (select doc_id, count(*) as n from sh group by doc_id),
common as (select a.doc_id as x, b.doc_id as y, count(*) as c from sh a join sh b using (s) where a.doc_id <> b.doc_id group by all),
links as (select x, y from common join n p on p.doc_id = x join n q on q.doc_id = y where 100 * c >= 80 * (p.n + q.n - c)),
reach as (select doc_id, doc_id as seen from documents union select r.doc_id, l.y from reach r join links l on l.x = r.seen)
select doc_id, coalesce(max(n.n), 0)::BIGINT as n_shingles, min(seen) as component_id, doc_id = min(seen) as kept from reach left join n using (doc_id) group by doc_id
""",
    "op11_merkle_manifest": f"""
with recursive crc as (select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end)) as tab),
h as (select doc_id, coalesce('=' || lang, '') as tree, {_leaf("n_chars")} as d, {_leaf("n_chars + 1")} as changed,
 xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)), lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 7 = 0 as hit
 from documents, crc),
leaves as (select *, row_number() over (partition by tree order by doc_id nulls first, d) - 1 as pos, count(*) over (partition by tree) as n from h),
nodes as ({_levels("leaves").format(name="nodes")}),
tops as (select tree as name, '' as tree, d, row_number() over (order by tree) - 1 as pos, count(*) over () as n from nodes where n = 1),
above as ({_levels("tops").format(name="above")}),
steps as (select tree, pos, level, before, d from ({_path("leaves", "nodes", 0)})
 union all select l.tree, l.pos, a.level, a.before, a.d from leaves l join tops t on t.name = l.tree join ({_path("tops", "above", 1000)}) a on a.pos = t.pos),
paths as (select tree, pos, list({{'before': before, 'd': d}} order by level) as path from steps group by all),
full_ as (select l.*, coalesce(path, []) as path, t.subroot, (select d from above where n = 1) as root from leaves l join (select name, d as subroot from tops) t on t.name = l.tree left join paths using (tree, pos)),
f as (select *, list_reduce(list_prepend({{'before': false, 'd': case when hit then changed else d end}}, path),
 lambda a, s: {{'before': false, 'd': sha256(case when s.before then s.d || a.d else a.d || s.d end)}}).d as folded_root from full_)
select doc_id, d as leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda s: s.d), '')) as proof_sha256, folded_root, folded_root = root as verified from f
""",
    "op12_ranked_search": f"""
with b as (select item_id, string_agg(text, ' ' order by text) as text from (select distinct item_id, text from benchmark where item_id is not null and text is not null) group by item_id),
q as (select item_id, term, count(*) as repeats from (select item_id, unnest({_TERMS}) as term from b) group by all),
d as (select row_number() over () as r, doc_id, {_TERMS} as ts from documents),
stats as (select count(*) filter (len(ts) > 0) as docs, sum(len(ts))::BIGINT as all_terms from d),
tf as (select r, term, count(*) as tf from (select r, unnest(ts) as term from d) where term in (select term from q) group by all),
w as (select term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT as w from tf, stats group by term, docs),
m as (select r, doc_id, 75 + (25 * len(ts) * docs) // all_terms as m from d, stats),
s as (select item_id, r, doc_id, sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT as score from q join tf using (term) join w using (term) join m using (r) group by all)
select item_id, (row_number() over (partition by item_id order by score desc, doc_id))::INTEGER as rank, doc_id, score from s where score > 0 and doc_id is not null
qualify row_number() over (partition by item_id order by score desc, doc_id) <= 20
""",
}
