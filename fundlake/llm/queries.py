"""The training-data queries: thin, each applies its operator to whole tables and derives the columns asked for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, collocations, embedding_dedup, fill_in_middle, jaccard_join, kneser_ney, packing, quality_classifier, quality_rules, reuse_encoding, secret_scan, token_counts, toxicity
from .common import read_table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's score by boosted trees over its statistics."""
    return quality_classifier.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's links and component, found by product quantisation."""
    return embedding_dedup.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each piece's sequence and place in it."""
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's bytes and tokens."""
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn is a call that the next turn answers; identifiers, order, schema and JSON as chat_format.link has them. Rows
    without a level have -1."""
    calls, results = chat_format.exchanges(read_table(spark, sf_dir, "conversations"))
    return chat_format.link(calls, results, chat_format.REPLY).select("conv_id", "call_id", "turn", F.coalesce("level", F.lit(-1)).alias("level"), "status", F.size("problems").cast("long").alias("n_problems"), "json")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each document's secrets, by patterns and by Markov models."""
    return secret_scan.summary(secret_scan.scan(read_table(spark, sf_dir, "documents"), "doc_id"))


def op7_bpe_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each document's ids and of what they decode to."""
    return reuse_encoding.encode_documents(read_table(spark, sf_dir, "documents"), texts=False)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's score by the conditional random field, and how many spans it tags."""
    scored = toxicity.score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted", F.size("spans").cast("long").alias("n_spans"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's number of shingles and component."""
    return jaccard_join.join(read_table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's measures, what the base rules say of it and what the learnt list does."""
    return quality_rules.judge(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each document's text as transformed and as restored from that."""
    cut = fill_in_middle.transform(read_table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)  # noqa: E731
    back = fill_in_middle.restored(F.col("output"), F.col("form"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(back).alias("restored_sha256"))


def op12_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's log10 probability by the model of all documents but those whose crc32 leaves 1 modulo 5, which are held out;
    so are documents without an id."""
    docs = read_table(spark, sf_dir, "documents")
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(True))
    scored = kneser_ney.score(docs, kneser_ney.train(docs.where(~out)))
    return scored.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's 2,000 strongest collocations."""
    return collocations.mine(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_classifier, op2_embedding_dedup, op3_best_fit_packing, op4_token_counts, op5_chat_format,
        op6_secret_scan, op7_bpe_reuse, op8_toxicity, op9_jaccard_join, op10_quality_rules,
        op11_fill_in_middle, op12_kneser_ney, op13_collocations,
    )
}  # fmt: skip

#: SQL where it can express the whole result. op2: all pairs within a label; op5: no cycle is possible there.
ORACLE_SQL: dict[str, str] = {
    "op2_embedding_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), good AS (
  SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND list_dot_product(e, e) > 0
), pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON p.a = r.b
), comp AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, comp.component_id, v.vec_id = comp.component_id AS kept
FROM v JOIN comp USING (vec_id) LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM pairs GROUP BY a) n USING (vec_id)
""",
    "op5_chat_format": """
WITH every AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
t AS (SELECT * FROM every WHERE turn IS NOT NULL),
c AS (SELECT conv_id, turn, text FROM t WHERE role = 'user'),
r AS (SELECT conv_id, turn - 1 AS call, turn AS result_turn, text AS content FROM t WHERE role IN ('assistant', 'tool')),
chain AS (SELECT conv_id, turn, turn - 2 * row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS grp FROM c),
lev AS (SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id, turn % 2, grp ORDER BY turn) - 1)::INTEGER AS level FROM chain),
j AS (
  SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.turn, r.call) AS id, coalesce(c.turn, r.result_turn) AS turn, coalesce(lev.level, -1)::INTEGER AS level,
    CASE WHEN c.turn IS NULL THEN 'orphan' WHEN r.call IS NULL THEN 'unanswered' ELSE 'linked' END AS status, c.text, r.content, c.turn AS called
  FROM c FULL JOIN r ON c.conv_id = r.conv_id AND c.turn = r.call LEFT JOIN lev ON lev.conv_id = c.conv_id AND lev.turn = c.turn
)
SELECT conv_id, 't' || id AS call_id, turn, level, status, 0::BIGINT AS n_problems,
  '{' || CASE WHEN called IS NULL THEN '' ELSE '"arguments":{"prompt":' || to_json(text)::VARCHAR || ',"turn":' || called || '},' END
  || '"id":"t' || id || '"' || CASE WHEN called IS NULL THEN '' ELSE ',"name":"reply"' END
  || CASE WHEN content IS NULL THEN '' ELSE ',"result":' || to_json(content)::VARCHAR END || ',"status":"' || status || '"}' AS json
FROM j
UNION ALL
SELECT conv_id, NULL, turn, -1, 'orphan', 0, '{"result":' || to_json(text)::VARCHAR || ',"status":"orphan"}'
FROM every WHERE role IS NULL OR role NOT IN ('user', 'assistant', 'tool') OR (turn IS NULL AND role <> 'user')
UNION ALL
SELECT conv_id, NULL, turn, -1, 'invalid', 1, '{"arguments":{"prompt":' || to_json(text)::VARCHAR || '},"name":"reply","status":"invalid"}'
FROM every WHERE turn IS NULL AND role = 'user'
""",
    "op9_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w
), n AS (SELECT doc_id, len(s)::BIGINT AS n_shingles FROM s),
one AS (SELECT doc_id, hash(unnest(s)) AS h FROM s),
pairs AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM one x JOIN one y ON x.h = y.h AND x.doc_id <> y.doc_id GROUP BY ALL)
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * o >= 80 * (na.n_shingles + nb.n_shingles - o)
), reach(a, b) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON p.a = r.b)
SELECT n.doc_id, n.n_shingles, c.component_id FROM n JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = n.doc_id
""",
    "op11_fill_in_middle": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
h AS (SELECT *, ('0x' || h[1:8])::UBIGINT AS h1, ('0x' || h[9:16])::UBIGINT AS h2, ('0x' || h[17:24])::UBIGINT AS h3, ('0x' || h[25:32])::UBIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1))::BIGINT AS a, greatest(h1 % (n + 1), h2 % (n + 1))::BIGINT AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p
""",
    "op13_collocations": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-]')) AS piece FROM documents
), w AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS w FROM pieces),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY 1),
grams AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])) AS p FROM w, range(1, 6) r(k) WHERE len(w) >= k),
f AS (SELECT lang, k, p, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
cand AS (SELECT * FROM f WHERE k >= 2),
inside AS (
  SELECT DISTINCT s.lang, s.p FROM (SELECT lang, f, k, unnest(list_transform(range(1, k - j + 2), lambda i: p[i:i + j - 1])) AS part FROM cand, range(2, 5) g(j) WHERE j < k) q
  JOIN cand s ON s.lang = q.lang AND s.p = q.part WHERE 100 * q.f >= 100 * s.f
),
cuts AS (
  SELECT c.lang, c.p, c.f AS a, j, l.f AS l, r.f AS r, n.n, (1000::HUGEINT * c.f * n.n) // (l.f::HUGEINT * r.f) AS score
  FROM cand c, range(1, 5) g(j), f l, f r, n WHERE j < c.k AND l.lang = c.lang AND r.lang = c.lang AND n.lang = c.lang AND l.p = c.p[1:j] AND r.p = c.p[j + 1:c.k]
    AND NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = c.lang AND i.p = c.p)
), best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, j) = 1),
named AS (SELECT *, array_to_string(p, ' ') AS phrase FROM best)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score FROM named
QUALIFY rank <= 2000
""",
}
