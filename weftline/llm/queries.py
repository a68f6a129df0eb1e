"""The registered queries of the training-data operators, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import chat, compaction, embeddings, langid, linededup, lmscore, manifest, minhash, mixing, packing, pagetext, quality, secrets
from weftline.llm.common import read

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, tokenizer_path()).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality.judge(docs, keep_text=False)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("quality", 9).alias("quality"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    good = read(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id")
    told = lmscore.score(docs, good)
    return told.select("doc_id", "n_tokens", *[F.round(c, 6).alias(c) for c in ("target_loss", "background_loss", "score")], "in_target")


OP3_SQL = r"""
WITH told AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND toxic = 0),
docs AS (
  SELECT d.doc_id, t.doc_id IS NOT NULL AS tgt, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents d LEFT JOIN told t USING (doc_id)
), tok AS (SELECT doc_id, tgt, len(ws) AS n, unnest(ws) AS b, unnest(list_concat([''], ws[1:len(ws) - 1])) AS a FROM docs WHERE len(ws) > 0),
own_w AS (SELECT doc_id, tgt, b, count(*) AS n FROM tok GROUP BY ALL), own_c AS (SELECT doc_id, tgt, a, count(*) AS n FROM tok GROUP BY ALL), own_p AS (SELECT doc_id, tgt, n AS size, a, b, count(*) AS n FROM tok GROUP BY ALL),
all_w AS (SELECT b, sum(n) AS n, coalesce(sum(n) FILTER (WHERE tgt), 0) AS t FROM own_w GROUP BY 1), all_c AS (SELECT a, sum(n) AS n, coalesce(sum(n) FILTER (WHERE tgt), 0) AS t FROM own_c GROUP BY 1),
all_p AS (SELECT a, b, sum(n) AS n, coalesce(sum(n) FILTER (WHERE tgt), 0) AS t FROM own_p GROUP BY 1, 2),
k AS (SELECT sum(n) AS n, sum(t) AS t, count(*) + 1 AS types, sum(t) / sum(n) AS share FROM all_w),
x AS (
  SELECT p.doc_id, p.size, p.n, p.tgt::INT AS g, types, share,
    wa.t - g * w.n AS wt, k.t - g * p.size AS tt, pa.t - g * p.n AS pt, ca.t - g * c.n AS ct,
    share * (wa.n - w.n) AS wb, share * (k.n - p.size) AS tb, share * (pa.n - p.n) AS pb, share * (ca.n - c.n) AS cb
  FROM own_p p JOIN own_w w ON w.doc_id = p.doc_id AND w.b = p.b JOIN own_c c ON c.doc_id = p.doc_id AND c.a = p.a JOIN all_w wa ON wa.b = p.b JOIN all_c ca ON ca.a = p.a JOIN all_p pa ON pa.a = p.a AND pa.b = p.b, k
), loss AS (
  SELECT doc_id, sum(n * -ln((pt + 50.0 * (wt + 0.5) / (tt + 0.5 * types)) / (greatest(ct, pt) + 50.0))) / any_value(size) AS t, sum(n * -ln((pb + 50.0 * (wb + 0.5) / (tb + 0.5 * types)) / (greatest(cb, pb) + 50.0))) / any_value(size) AS b
  FROM x GROUP BY 1
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_tokens, round(t, 6) AS target_loss, round(b, 6) AS background_loss, round(b - t, 6) AS score, tgt AS in_target FROM docs LEFT JOIN loss USING (doc_id)
"""


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], rows.schema)
    return chat.digest(chat.format_chats(chat.as_stream(rows.unionByName(planted))))


OP4_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), escaped AS (
  SELECT *, length(regexp_replace(role, '([<\[])(\\*)(/?s>|/?INST\]|</?SYS>>)', '\1\\\2\3', 'g'))
    + length(regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\]|</?SYS>>)', '\1\\\2\3', 'g')) AS n FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n + 20) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
"""


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    rated, domains = mixing.rates(docs, read(spark, sf_dir, "labels"))
    p = [F.round(F.element_at("p", i + 1), 9).alias(f"p_{d}") for i, d in enumerate(domains)]
    return rated.select("doc_id", "n_tokens", *p, F.round("rate", 9).alias("rate"), "copies")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))


OP6_SQL = r"""
WITH marked AS (
  SELECT doc_id, regexp_replace(regexp_replace(text, '([.!?])([ \t]+)', '\1' || chr(1) || '\2' || chr(2), 'g'), '(\n+)', chr(1) || '\1' || chr(2), 'g') AS t FROM documents WHERE text IS NOT NULL
), pieces AS (SELECT doc_id, unnest(string_split(t, chr(2))) AS piece, generate_subscripts(string_split(t, chr(2)), 1) AS k FROM marked),
units AS (SELECT doc_id, k, split_part(piece, chr(1), 1) AS unit, split_part(piece, chr(1), 2) AS sep FROM pieces),
words AS (SELECT *, list_filter(regexp_split_to_array(unit, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS own FROM units),
tokens AS (SELECT doc_id, k, unit, sep, len(own) AS n, list_transform(own, lambda w: CASE WHEN regexp_matches(w, '[0-9]') THEN '<*>' ELSE w END) AS ws FROM words),
keys AS (
  SELECT doc_id, k, unnest(CASE WHEN n = 0 THEN [] WHEN n < 10 THEN [n || ':' || array_to_string(ws, ' ')]
    ELSE [n || 'a' || array_to_string(list_concat(ws[1:4], ws[(4 + n) // 2 + 1:]), ' '), n || 'b' || array_to_string(ws[1:(4 + n) // 2], ' ')] END) AS key FROM tokens
), firsts AS (SELECT key, min(doc_id) AS first_id FROM keys GROUP BY 1),
hits AS (SELECT DISTINCT doc_id, k, true AS hit FROM keys JOIN firsts USING (key) WHERE first_id < doc_id),
told AS (SELECT doc_id, k, n, coalesce(hit, false) AS hit FROM tokens LEFT JOIN hits USING (doc_id, k) WHERE n > 0),
runs AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) - row_number() OVER (PARTITION BY doc_id, hit ORDER BY k) AS run FROM told),
gone AS (SELECT doc_id, k, hit AND sum(n) OVER (PARTITION BY doc_id, hit, run) >= 6 AS gone FROM runs),
left_ AS (
  SELECT doc_id, count(*) FILTER (WHERE gone) AS n_dropped, rtrim(coalesce(string_agg(unit || sep, '' ORDER BY k) FILTER (WHERE NOT coalesce(gone, false)), ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t
  FROM tokens LEFT JOIN gone USING (doc_id, k) GROUP BY 1
)
SELECT doc_id, CASE WHEN n_dropped > 0 THEN t ELSE text END AS text, coalesce(n_dropped, 0) AS n_dropped FROM documents LEFT JOIN left_ USING (doc_id)
"""


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = langid.fit(docs.where(~held_out), "text", "lang", key="doc_id")
    told = langid.identify(docs.select("doc_id", "text"), model)
    return told.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(secrets.listed(F.col("base")), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return minhash.near_duplicates(docs, percent=85)


#: Classes of links between documents, by reachability: the smallest id that a document reaches.
_REACHED = """reach(id, c) AS (SELECT id, id FROM nodes UNION SELECT e.v, r.c FROM reach r JOIN edges e ON e.u = r.id), least AS (SELECT id, min(c) AS component_id FROM reach GROUP BY 1)"""

OP9_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), places AS (
  SELECT doc_id, ws, unnest(CASE WHEN len(ws) >= 5 THEN range(1, len(ws) - 3) WHEN len(ws) > 0 THEN [1] ELSE [] END) AS i FROM w
), sh AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], chr(10)) AS s FROM places),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
both_ AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT u, v FROM both_ JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * c >= 85 * (a.n + b.n - c)),
edges AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links), nodes AS (SELECT doc_id AS id FROM documents),
{_REACHED}
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d LEFT JOIN n USING (doc_id) JOIN least ON id = d.doc_id
"""


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(read(spark, sf_dir, "embeddings"))


OP10_SQL = f"""
WITH RECURSIVE x AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
fine AS (SELECT * FROM x WHERE len(list_filter(e, lambda v: v IS NULL OR isnan(v) OR isinf(v))) = 0 AND len(list_filter(e, lambda v: v <> 0)) > 0),
links AS (SELECT a.vec_id AS u, b.vec_id AS v FROM fine a JOIN fine b ON a.label = b.label AND a.vec_id < b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
edges AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links), nodes AS (SELECT vec_id AS id FROM embeddings),
{_REACHED}, n AS (SELECT u AS id, count(*) AS n FROM edges GROUP BY 1)
SELECT id AS vec_id, coalesce(n, 0) AS n_links, component_id, id = component_id AS kept FROM least LEFT JOIN n USING (id)
"""


def op11_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction.compacted(spark.read.parquet(f"{sf_dir}/clicks.parquet"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.third_tampered(read(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text"))


def _tree_sql(of: str, levels: int) -> str:
    """CTEs over {of}0 (t, i, h): nodes {of}k of each level, runs {of}rk with their concatenated digests; what is alone stays."""
    out = ""
    for k in range(levels):
        out += f"""{of}r{k} AS (SELECT t, i // 8 AS i, count(*) AS n, max(count(*)) OVER (PARTITION BY t) > 1 OR count(*) OVER (PARTITION BY t) > 1 AS many, string_agg(h, '' ORDER BY i) AS s FROM {of}{k} GROUP BY 1, 2),
{of}{k + 1} AS (SELECT t, i, CASE WHEN many THEN sha256(s) ELSE s END AS h FROM {of}r{k}),
"""
    return out


def _climb_sql(of: str, start: str, levels: int) -> str:
    """CTEs that follow each row of start (row, t, i, proof, fold) to the root of its tree."""
    out, last = "", start
    for k in range(levels):
        at = "l.i % 8"
        out += f"""{of}c{k} AS (SELECT l.row, l.t, l.i // 8 AS i, CASE WHEN many THEN proof || s[1:64 * ({at})] || s[64 * ({at}) + 65:] ELSE proof END AS proof,
  CASE WHEN many THEN sha256(s[1:64 * ({at})] || fold || s[64 * ({at}) + 65:]) ELSE fold END AS fold FROM {last} l JOIN {of}r{k} r ON r.t = l.t AND r.i = l.i // 8),
"""
        last = f"{of}c{k}"
    return out


_FRAMED = "coalesce(octet_length(encode(CAST({0} AS VARCHAR)))::VARCHAR || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = lambda text: "sha256(" + " || ".join(_FRAMED.format(c) for c in ("doc_id", "source", "lang", "n_chars")) + " || " + _FRAMED.format(text) + ")"
_LEVELS, _TOP = 9, 4

OP12_SQL = f"""
WITH crc AS (SELECT list(x.v ORDER BY x.b) AS t FROM (SELECT b, list_reduce(list_prepend(b, range(8)), lambda a, _: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM (SELECT unnest(range(256)) AS b)) x),
given AS (SELECT *, row_number() OVER () AS row, list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda k: CAST(ascii(CAST(doc_id AS VARCHAR)[k]) AS BIGINT)) AS codes FROM documents),
keyed AS (SELECT *, xor(list_reduce(list_prepend(4294967295, codes), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS crc FROM given, crc),
leaves AS (SELECT doc_id, row, coalesce('+' || lang, '') AS t, {_LEAF('text')} AS leaf, CASE WHEN crc % 3 = 0 THEN {_LEAF("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS forged FROM keyed),
n0 AS (SELECT row, doc_id, forged, t, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf AS h FROM leaves),
{_tree_sql('n', _LEVELS)}
s0 AS (SELECT 0 AS t, row_number() OVER (ORDER BY encode(t)) - 1 AS i, h, t AS name FROM n{_LEVELS}),
{_tree_sql('s', _TOP)}
w0 AS (SELECT row, t, i, '' AS proof, coalesce(forged, h) AS fold FROM n0),
{_climb_sql('n', 'w0', _LEVELS)}
v0 AS (SELECT c.row, s0.t, s0.i, proof, fold FROM nc{_LEVELS - 1} c JOIN s0 ON s0.name = c.t),
{_climb_sql('s', 'v0', _TOP)}
told AS (SELECT n0.doc_id, n0.h AS leaf, s0.h AS subroot, (SELECT h FROM s{_TOP}) AS root, sha256(proof) AS proof_sha256, fold AS folded_root FROM sc{_TOP - 1} c JOIN n0 USING (row) JOIN s0 ON s0.name = n0.t)
SELECT *, folded_root = root AS verified FROM told
"""


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pagetext.extract(read(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


#: The same pages read by their one template: what stands in the article element, cut at its blocks.
OP13_SQL = r"""
WITH inner_ AS (SELECT page_id, url, coalesce(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '') AS a FROM pages),
cut AS (SELECT page_id, url, list_transform(regexp_split_to_array(a, '</?(?:p|h1)>'), lambda x: regexp_replace(x, '<[^>]*>', ' ', 'g')) AS b FROM inner_),
said AS (SELECT page_id, url, list_transform(b, lambda x: regexp_replace(replace(replace(replace(replace(x, '&quot;', '"'), '&#x27;', chr(39)), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g')) AS b FROM cut),
told AS (SELECT page_id, url, array_to_string(list_filter(list_transform(b, lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text FROM said)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM told
"""


def queries() -> dict[str, Query]:
    from corpus_pipeline import run as pipeline

    found = {f.__name__: f for f in (op1_best_fit_packing, op2_quality_rules, op3_lm_scoring, op4_chat_formatting, op5_mixing, op6_line_dedup, op7_language_id, op8_secret_scans, op9_minhash_near_dedup, op10_embedding_near_dedup, op11_compaction, op12_merkle_manifest, op13_html_extraction)}
    return found | {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return {"op3_lm_scoring": OP3_SQL, "op4_chat_formatting": OP4_SQL, "op6_line_dedup": OP6_SQL, "op9_minhash_near_dedup": OP9_SQL, "op10_embedding_near_dedup": OP10_SQL, "op12_merkle_manifest": OP12_SQL, "op13_html_extraction": OP13_SQL}
