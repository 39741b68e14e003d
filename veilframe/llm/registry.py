"""One query per corpus operator over its whole table, with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm import (
    exact_search,
    graph_search,
    hard_negatives,
    language,
    lines,
    near_copies,
    packing,
    piece_coding,
    prefix_trie,
    suffix_dedup,
    toxicity,
    url_rules,
    warc,
)
from veilframe.llm.common import id_crc, table
from veilframe.plans.scale import delete, tidy, work_dir, written

Query = Callable[[SparkSession, str], DataFrame]

TOKENIZER = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"

SITE_RULES = (
    url_rules.site_rule("org", "/", "allow"),
    url_rules.site_rule("example.org", "/es/", "block"),
    url_rules.site_rule("example.org", "/en/1", "block"),
    url_rules.site_rule("com", "/fr/", "allow"),
    url_rules.site_rule("com", "/de/", "block"),
)
WORD_RULES = tuple(
    url_rules.word_rule(w)
    for w in (
        "spam", "spam farm", "cheap pills", "pills", "casino", "free bets", "betting", "poker",
        "viagra", "porn", "xxx", "sex", "malware", "warez", "torrent", "payday loans",
    )
)


def public_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_near_copies(spark: SparkSession, d: str) -> DataFrame:
    return near_copies.near_copies(table(spark, d, "documents"))


def op3_suffix_dedup(spark: SparkSession, d: str) -> DataFrame:
    return suffix_dedup.measure_repeats(table(spark, d, "documents"))


def op2_toxicity(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, d, "labels"))
    scored = toxicity.score_toxicity(docs, model)
    held_out = (id_crc(F.col("doc_id"), 5) == 0).alias("held_out")
    return scored.select("doc_id", held_out, "score", "predicted")


def op4_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents"), public_file(TOKENIZER))


def op5_line_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Every document with its boilerplate lines dropped; `source` is the site."""
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    done = lines.drop_boilerplate(docs)
    kept = F.md5(F.col("text").cast("binary")).alias("kept_md5")
    return done.select("doc_id", "n_lines", "n_dropped", F.length("text").alias("n_chars"), kept)


OP5_SQL = r"""
with page as (
    select doc_id, source, text, string_split(text, chr(10)) as lines from documents
), line as (
    select doc_id, source, i, lines[i] as line,
           trim(regexp_replace(lines[i], '\s+', ' ', 'g')) as bare
    from (select *, unnest(range(1, len(lines) + 1)) as i from page)
), often as (
    select source, bare, count(distinct doc_id) as n from line where bare <> '' group by all
), total as (
    select source, count(*) as n from documents group by all
), boiler as (
    select o.source, o.bare from often o join total t on o.source is not distinct from t.source
    where o.n >= 2 and o.n::double / t.n > 0.05
), kept as (
    select l.doc_id, count(*) filter (b.bare is not null) as n_dropped,
           coalesce(string_agg(l.line, chr(10) order by l.i) filter (b.bare is null), '') as text
    from line l left join boiler b on l.bare = b.bare and l.source is not distinct from b.source
    group by l.doc_id
)
select p.doc_id, coalesce(len(p.lines), 0)::int as n_lines, coalesce(k.n_dropped, 0)::int as n_dropped,
       length(k.text)::int as n_chars, md5(k.text) as kept_md5
from page p left join kept k on p.doc_id = k.doc_id
"""


def op6_piece_coding(spark: SparkSession, d: str) -> DataFrame:
    return piece_coding.digest(table(spark, d, "documents"), public_file(PIECES))


def op7_url_filters(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select("page_id", "url")
    judged = url_rules.filter_urls(pages, SITE_RULES + WORD_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op7_sql() -> str:
    words = " or ".join(f"regexp_matches(target, '{r.pattern}')" for r in WORD_RULES)
    sites = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in sites)
    return f"""
with page as (
    select page_id, url, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end as tail from pages
), split as (
    select page_id, url, translate(regexp_extract(tail, '^[^/?#]*'), '{url_rules.UPPER}', '{url_rules.LOWER}') as host,
           regexp_extract(tail, '^[^/?#]*([^?#]*)', 1) as path
    from page
), rule(h, p, v) as (values {values}), fit as (
    select s.page_id, arg_max(h || p, length(h || p)) as rule, arg_max(v, length(h || p)) as verdict
    from split s join rule on (s.host = h or ends_with(s.host, '.' || h)) and starts_with(s.path, p)
    group by s.page_id
), target as (select *, host || path as target from split)
select t.page_id, coalesce(t.host, '') as host, coalesce(t.path, '') as path, f.rule as rule,
       coalesce(f.verdict, case when {words} then 'block' else 'allow' end) as verdict
from target t left join fit f on t.page_id = f.page_id
"""


def op8_exact_search(spark: SparkSession, d: str) -> DataFrame:
    vectors = exact_search.finite_vectors(table(spark, d, "embeddings"), "vec_id", "embedding")
    rows = vectors.select("id", exact_search.quantised(F.col("vec"), 64).alias("vec"))
    return exact_search.top_k(rows, F.col("id") % 20 == 0, 20)


OP8_SQL = """
with vec as (
    select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as v from embeddings
    where embedding is not null
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), pair as (
    select q.vec_id as query_id, c.vec_id, list_dot_product(q.v, c.v)::bigint as score
    from vec q join vec c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % 20 = 0
)
select query_id, (row_number() over best)::int as rank, vec_id, score from pair
window best as (partition by query_id order by score desc, vec_id)
qualify row_number() over best <= 20
"""


def op9_language_id(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    profiles = language.learn_profiles(docs.where(id_crc(F.col("doc_id"), 3) != 1))
    labelled = language.predict_language(docs.select("doc_id", "text"), written(profiles))
    held_out = (id_crc(F.col("doc_id"), 3) == 1).alias("held_out")
    return labelled.select("doc_id", held_out, "lang_pred", "score")


def op10_graph_search(spark: SparkSession, d: str) -> DataFrame:
    rows = exact_search.finite_vectors(table(spark, d, "embeddings"), "vec_id", "embedding")
    return graph_search.nearest(rows, F.col("id") % 50 == 0, 5)


def op11_prefix_trie(spark: SparkSession, d: str) -> DataFrame:
    """Conversations are rebuilt as forks of every fifth one, with up to 8 of its turns."""
    convs, turns = prefix_trie.forked(prefix_trie.turn_table(table(spark, d, "conversations")), every=5, most=9)
    return prefix_trie.prefix_trie(convs, turns)


OP11_SQL = """
with turn as (
    select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
           row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), md5(coalesce(text, ''))) - 1 as pos
    from conversations where conv_id is not null
), sized as (
    select conv_id, count(*) as n, conv_id - conv_id % 5 as base,
           list_transform(range(1, len(conv_id::varchar) + 1), lambda i: ord(substr(conv_id::varchar, i::int, 1))::bigint) as codes
    from turn group by conv_id
), coded as (  -- crc32, a bit at a time: each byte is followed by seven zeros
    select conv_id, n, base, xor(list_reduce(
             list_prepend(4294967295::bigint, flatten(list_transform(codes, lambda b: [b, 0, 0, 0, 0, 0, 0, 0]))),
             lambda acc, e: xor(xor(acc, e) >> 1, (xor(acc, e) & 1) * 3988292384)), 4294967295) % 9 as h
    from sized
), conv as (
    select c.conv_id, c.base, c.h, least(c.h, coalesce(b.n, 0)) as taken,
           least(c.h, coalesce(b.n, 0)) + greatest(c.n - c.h, 0) as n_turns
    from coded c left join sized b on c.base = b.conv_id
), rebuilt as (
    select c.conv_id, t.pos + 1 as depth, role, text, n_turns from conv c join turn t on t.conv_id = c.base where t.pos < c.taken
    union all
    select c.conv_id, c.taken + t.pos - c.h + 1, role, text, n_turns from conv c join turn t on t.conv_id = c.conv_id where t.pos >= c.h
), member as (
    select conv_id, depth, n_turns, strlen(text) as bytes,
           md5(string_agg(md5(role) || md5(text), '') over (partition by conv_id order by depth)) as node
    from rebuilt
    union all select conv_id, 0, n_turns, 0, '' from conv
), node as (
    select depth, node, min(conv_id) as conv_id, count(*) as n_convs, max(bytes) as bytes, max(n_turns) as deepest,
           sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (n_turns = depth), '')) as ends_sha256
    from member group by depth, node
), total as (  -- a node's first member passes all of its ancestors
    select m.depth, m.node, count(*) filter (d.depth = m.depth + 1) as n_children,
           count(*) filter (d.deepest = d.depth) as n_leaves, sum((d.n_convs - 1) * d.bytes)::bigint as saved_tokens
    from node d join member m on m.conv_id = d.conv_id and m.depth <= d.depth
    group by m.depth, m.node
)
select n.conv_id, n.depth::bigint as depth, p.conv_id as parent_conv_id, n.n_convs, t.n_children, t.n_leaves,
       t.saved_tokens, n.ends_sha256
from node n join total t on n.depth = t.depth and n.node = t.node
left join member m on m.conv_id = n.conv_id and m.depth = n.depth - 1
left join node p on p.depth = m.depth and p.node = m.node
"""


def op12_hard_negatives(spark: SparkSession, d: str) -> DataFrame:
    """Every fiftieth vector is an anchor; labels of every seventh are moved on by one first."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, d, "embeddings").select("vec_id", moved.alias("label"), "embedding")
    rows = hard_negatives.labelled_vectors(vectors, 256)
    return hard_negatives.hard_negatives(rows, F.col("id") % 50 == 0)


OP12_SQL = """
with vec as (
    select distinct vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
           list_transform(embedding, lambda x: floor(256 * x::double)) as v
    from embeddings
    where vec_id is not null and label is not null and embedding is not null
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), pair as (
    select a.vec_id as anchor_id, c.vec_id, a.label = c.label as same, list_dot_product(a.v, c.v)::bigint as score
    from vec a join vec c on a.vec_id <> c.vec_id and len(a.v) = len(c.v) where a.vec_id % 50 = 0
), positive as (
    select anchor_id, vec_id as positive_id, score as positive_score from pair where same
    qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
)
select p.anchor_id, p.positive_id, (row_number() over best)::int as rank, n.vec_id as negative_id,
       p.positive_score, n.score as negative_score
from positive p join pair n on p.anchor_id = n.anchor_id and not n.same
  and 50 * p.positive_score <= 100 * n.score and 100 * n.score <= 95 * p.positive_score
window best as (partition by p.anchor_id, p.positive_id order by n.score desc, n.vec_id)
qualify row_number() over best <= 3
"""


def op13_warc(spark: SparkSession, d: str) -> DataFrame:
    """The pages written to archives and read back; the archives go when that is done."""
    path = work_dir(spark, "warc")
    warc.write_archives(table(spark, d, "pages"), path)
    found = warc.captures(spark, path)
    delete(spark, path)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem")


OP13_SQL = """
with page as (
    select distinct page_id, strlen(coalesce(html, '')) as n, sha256(coalesce(html, '')) as digest from pages
), shared as (
    select digest, min(page_id) as first from page where n >= 100 group by digest
), found as (
    select p.*, case when s.first is not null and (p.page_id is null or p.page_id > s.first) then s.first end as refers_to
    from page p left join shared s on p.digest = s.digest
)
select page_id, n::bigint as payload_bytes, digest as payload_digest,
       case when refers_to is null then 'response' else 'revisit' end as record_type, refers_to, null::varchar as problem
from found
"""


QUERIES: dict[str, Query] = {
    "op1_near_copies": op1_near_copies,
    "op2_toxicity": op2_toxicity,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_packing": op4_packing,
    "op5_line_dedup": op5_line_dedup,
    "op6_piece_coding": op6_piece_coding,
    "op7_url_filters": op7_url_filters,
    "op8_exact_search": op8_exact_search,
    "op9_language_id": op9_language_id,
    "op10_graph_search": op10_graph_search,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_warc": op13_warc,
}
QUERIES = {name: tidy(run) for name, run in QUERIES.items()}

ORACLES: dict[str, str] = {
    "op5_line_dedup": OP5_SQL,
    "op7_url_filters": op7_sql(),
    "op8_exact_search": OP8_SQL,
    "op11_prefix_trie": OP11_SQL,
    "op12_hard_negatives": OP12_SQL,
    "op13_warc": OP13_SQL,
}
