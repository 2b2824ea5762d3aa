"""The numbered queries: each applies its operator to its whole table and gives the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from reelsift.llm import collocations, embedding_dedup, langid, license_scan, lm_score, mixing, ngram_join, packing, secret_scan, warc
from reelsift.llm.common import crc_mod, read_table
from reelsift.llm.conversation_trie import conversation_trie
from reelsift.llm.exact_dedup import exact_dedup
from reelsift.llm.substring_dedup import remove_repeats

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


@register("op9_exact_dedup", sql=r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, h AS text_sha256
FROM t WINDOW w AS (PARTITION BY h)""")
def op9_exact_dedup(spark, sf_dir):
    """Exact copies of every document after white space is normalised."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@register("op1_language_id")
def op1_language_id(spark, sf_dir):
    """Language of every document; learns from labelled documents outside the held-out third."""
    docs = read_table(spark, sf_dir, "documents")
    held_out = crc_mod(F.col("doc_id"), 3) == 1
    model = langid.fit(docs, "doc_id", "text", "lang", ~held_out)
    return (langid.identify(docs.select("doc_id", "text"), model)
            .select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "cross_entropy", "n_predicted", "rejected"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@register("op3_packing")
def op3_packing(spark, sf_dir):
    """All documents in sequences of at most 2048 tokens, one row per piece."""
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), tokenizer_path())


@register("op5_warc", sql="""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
     f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id > first THEN first END AS refers_to
FROM f""")
def op5_warc(spark, sf_dir):
    """Every page written to gzip archives and read back record by record."""
    manifest = warc.archive(read_table(spark, sf_dir, "pages"))
    back = warc.read_archives(manifest, with_payload=False)
    return back.select(F.nullif("record_id", F.lit("")).cast("long").alias("page_id"), "payload_bytes", "payload_digest",
                       "record_type", F.col("refers_to").cast("long").alias("refers_to"))


@register("op2_ngram_jaccard")
def op2_ngram_jaccard(spark, sf_dir):
    """Documents linked at a Jaccard similarity of 0.9 or more of their 3-word shingles."""
    docs = read_table(spark, sf_dir, "documents")
    return (ngram_join.jaccard_classes(docs, n=3, num=90, den=100)
            .select("doc_id", "n_shingles", "component_id"))


@register("op4_mixing")
def op4_mixing(spark, sf_dir):
    """All documents mixed to 150 % of their words, the sources weighing 5, 2, 1 in turn."""
    rows = mixing.sized(read_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    mix = mixing.plan_mix(rows)
    taken = mixing.copies(rows, mix).alias("r")
    return (taken.join(mix.sources.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")))
            .select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "r.source", "copies"))


@register("op8_secret_scan")
def op8_secret_scan(spark, sf_dir):
    """Secrets in every document: three patterns, and runs that the Markov models call random."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scan.scan(docs, secret_scan.train(docs, "doc_id", "text"))
    base = F.filter("spans", lambda s: s["rank"] < 3)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(secret_scan.written(base), 256).alias("base_sha256"),
                        secret_scan.written(F.col("spans")).alias("spans"), "n_markov")


@register("op7_license_scan")
def op7_license_scan(spark, sf_dir):
    """License statements in every document."""
    return license_scan.scan(read_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text", "detections")


@register("op6_embedding_dedup")
def op6_embedding_dedup(spark, sf_dir):
    """Embeddings linked at a cosine of 0.9 or more."""
    return (embedding_dedup.near_duplicates(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
            .select("vec_id", "n_links", "component_id", "kept"))


@register("op10_lm_score")
def op10_lm_score(spark, sf_dir):
    """Log10 probability of every document, learned from the documents that are not held out."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_mod(F.col("doc_id"), 5) == 1
    return (lm_score.fit_score(docs, "doc_id", "text", ~held_out)
            .select("doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"))


@register("op11_conversation_trie", sql=r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
           FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS base,
             xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::UBIGINT)),
                             lambda a, x: list_reduce([xor(a, x), 0, 0, 0, 0, 0, 0, 0, 0],
                                                      lambda v, z: xor(v >> 1, 3988292384::UBIGINT * (v & 1::UBIGINT)))), 4294967295::UBIGINT) % 4 AS h
      FROM (SELECT DISTINCT conv_id FROM t)),
s AS (SELECT c.conv_id, 0 AS part, pos, role, text FROM c JOIN t ON t.conv_id = c.base AND pos < h
      UNION ALL SELECT c.conv_id, 1, pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND pos >= h),
p AS (SELECT conv_id, row_number() OVER w AS depth, string_agg(sha256(role || chr(0) || text), '') OVER w AS k, text FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos)),
m AS (SELECT conv_id, depth, k, substr(k, 1, 64 * (depth - 1)) AS up, text, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM p
      UNION ALL SELECT conv_id, 0, '', NULL, '', conv_id NOT IN (SELECT conv_id FROM p) FROM c),
n AS (SELECT k, any_value(up) AS up, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
             string_agg(CASE WHEN ends THEN conv_id END, ',' ORDER BY conv_id) AS ids,
             (count(*) - 1) * any_value(len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> ''))) AS saved FROM m GROUP BY k),
d AS (SELECT n.*, coalesce(x.c, 0) AS n_children FROM n LEFT JOIN (SELECT up, count(*) AS c FROM n GROUP BY up) x ON x.up = n.k),
b AS (SELECT m.k, sum(d.saved) AS saved, count(*) FILTER (n_children = 0) AS leaves FROM d JOIN m ON m.conv_id = d.conv_id AND m.depth <= d.depth GROUP BY m.k)
SELECT d.conv_id, CAST(d.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, d.n_convs, d.n_children, b.leaves AS n_leaves,
       CAST(b.saved AS BIGINT) AS saved_tokens, sha256(coalesce(d.ids, '')) AS ends_sha256
FROM d JOIN b USING (k) LEFT JOIN d u ON u.k = d.up""")
def op11_conversation_trie(spark, sf_dir):
    """The prefix trie of all conversations, rebuilt on the heads of their bases."""
    return conversation_trie(read_table(spark, sf_dir, "conversations")).drop("ref")


@register("op12_collocations", sql=r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang,
                  regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps FROM documents),
p AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM (SELECT lang, unnest(ps) AS p FROM d)),
s AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM p),
g AS (SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS phrase FROM s, (SELECT unnest(range(1, 6)) AS m) WHERE i + m - 1 <= len(ws)),
f AS (SELECT lang, phrase, m, count(*) AS n FROM g GROUP BY ALL HAVING count(*) >= 100),
t AS (SELECT lang, count(*) AS n FROM s GROUP BY lang),
c AS (SELECT lang, phrase, string_split(phrase, ' ') AS w, m, n AS a FROM f WHERE m > 1),
k AS (SELECT *, unnest(range(1, m)) AS k FROM c),
cut AS (SELECT k.lang, k.phrase, a, k, l.n AS l, r.n AS r, t.n AS n, CAST(CAST(1000 AS HUGEINT) * a * t.n // (CAST(l.n AS HUGEINT) * r.n) AS BIGINT) AS score
        FROM k JOIN f l ON l.lang = k.lang AND l.phrase = array_to_string(w[1:k], ' ')
               JOIN f r ON r.lang = k.lang AND r.phrase = array_to_string(w[k + 1:k.m], ' ') JOIN t ON t.lang = k.lang),
b AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT DISTINCT lang, array_to_string(w[x:x + y - 1], ' ') AS phrase, a
      FROM c, (SELECT unnest(range(1, 5)) AS x), (SELECT unnest(range(2, 5)) AS y) WHERE y < m AND x + y - 1 <= m),
o AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.lang = b.lang AND i.phrase = b.phrase AND 100 * i.a >= 100 * b.a))
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o) WHERE rank <= 2000""")
def op12_collocations(spark, sf_dir):
    """The first 2,000 collocations of every language."""
    return collocations.collocations(read_table(spark, sf_dir, "documents").select("lang", "text"))


@register("op13_substring_dedup", sql=r"""
WITH w AS (SELECT row_number() OVER () AS id, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT id, ws, unnest(range(1, len(ws) - 33)) AS s FROM w WHERE len(ws) >= 35),
r AS (SELECT id, s FROM (SELECT id, s, count(*) OVER (PARTITION BY array_to_string(ws[s:s + 34], ' ')) AS c FROM p) WHERE c > 1),
m AS (SELECT DISTINCT id, i FROM (SELECT id, unnest(range(s, s + 35)) AS i FROM r)),
a AS (SELECT id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
k AS (SELECT a.id, string_agg(CASE WHEN m.i IS NULL THEN a.word END, ' ' ORDER BY a.i) AS t, count(m.i) AS g FROM a LEFT JOIN m ON a.id = m.id AND a.i = m.i GROUP BY a.id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(g, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN k USING (id)""")
def op13_substring_dedup(spark, sf_dir):
    """All documents without the passages of 35 words or more that also stand elsewhere."""
    kept = remove_repeats(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
