"""Registered queries of the training-data operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvella.llm import byte_bpe, chat_tree, exact_dedup, graph_ann, hard_negatives, html_text, labelled, near_dedup, packing, quality, spelling, token_files, toxicity, vocabularies, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"), vocabularies.path("byte_bpe_50k.json"))


def op3_token_range_coder(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_token_files(_read(spark, sf_dir, "documents"), vocabularies.path("word_bpe_49k.json"), alphabet=49_408)
    return token_files.read_token_files(manifest)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_read(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = _read(spark, sf_dir, "documents"), labelled.fold("doc_id", 3) == 1
    model = quality.fit_on(docs, _read(spark, sf_dir, "labels"), ~held)
    return quality.score(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "score", "predicted")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = _read(spark, sf_dir, "documents"), labelled.fold("doc_id", 5) == 0
    model = toxicity.fit_on(docs, _read(spark, sf_dir, "labels"), ~held)
    return toxicity.score(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "score", "predicted")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(_read(spark, sf_dir, "documents"), vocabularies.path("byte_bpe_multi_50k.tiktoken"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_read(spark, sf_dir, "documents"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_read(spark, sf_dir, "pages"))


def op1_graph_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")
    index, shards = graph_ann.build_index(vectors)
    return graph_ann.search(vectors.filter("vec_id % 20 = 0"), index, shards)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages")
    index = warc.write_index(warc.write_archives(pages))
    return warc.lookup(warc.page_keys(pages), index)


def op11_chat_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(more)
    return chat_tree.read_back(chat_tree.build(rows))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(_read(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_graph_ann": op1_graph_ann,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_token_range_coder": op3_token_range_coder,
    "op4_warc": op4_warc,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_quality": op6_quality,
    "op10_toxicity": op10_toxicity,
    "op7_html_text": op7_html_text,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_near_dedup": op9_near_dedup,
    "op11_chat_prefix_tree": op11_chat_prefix_tree,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLES: dict[str, str] = {
    "op4_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        q AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS d, min(page_id) OVER (PARTITION BY h) AS first_id FROM p)
        SELECT page_id, payload_bytes,
               list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   1 + (((('0x' || substr(d, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31))::INT, 1)), 'string_agg', '') AS payload_digest,
               CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
        FROM q
    """,
    "op5_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY t)
    """,
    "op11_chat_prefix_tree": r"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, i, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(i, role)
        ),
        c AS (
            SELECT *, '[<\[]\\*(?:\|im_start\|>|\|im_end\|>|\|im_sep\|>|\|endoftext\|>|\|begin_of_text\|>|\|eot_id\|>|\|start_header_id\|>|\|end_header_id\|>|s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>)' AS control,
                   sha256(role || chr(10) || text) AS digest, replace(replace(role, '\', '\\'), chr(10), '\n') AS line
            FROM t
        )
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, digest)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, digest) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(length('<|im_start|>' || line || chr(10) || text || '<|im_end|>' || chr(10)) + len(regexp_extract_all(line, control)) + len(regexp_extract_all(text, control)))::BIGINT AS formatted_chars
        FROM c GROUP BY conv_id
    """,
    "op12_hard_negatives": """
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ),
        scored AS (
            SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS alike, list_inner_product(a.q, b.q)::BIGINT AS score
            FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0
        ),
        positives AS (
            SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE alike
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
        )
        SELECT anchor_id, positive_id, row_number() OVER w AS rank, other_id AS negative_id, positive_score, score AS negative_score
        FROM positives JOIN scored USING (anchor_id)
        WHERE NOT alike AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
        WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)
        QUALIFY row_number() OVER w <= 10
    """,
    "op13_spelling_variants": """
        WITH RECURSIVE steps AS MATERIALIZED (
            SELECT list(crc ORDER BY k) AS t
            FROM (SELECT k, list_reduce(range(0, 9), lambda c, i: CASE WHEN i = 0 THEN c WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k) AS crc FROM range(256) AS r(k))
        ),
        runs AS (
            SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
            FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) GROUP BY ALL
        ),
        named AS (SELECT *, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS bytes FROM runs),
        hashed AS (
            SELECT run, n, xor(4294967295, list_reduce(range(0, length(bytes) // 2), lambda c, i:
                xor(c >> 8, t[1 + (xor(c, ('0x' || substr(bytes, 2 * i + 1, 2))::BIGINT) & 255)]), 4294967295)) AS h
            FROM named, steps
        ),
        spelled AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, 2 + (h % length(run))::INT) ELSE run END AS word, n FROM hashed),
        words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM spelled WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
        cut AS MATERIALIZED (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM words, unnest(range(0, length(word))) AS u(i)),
        pairs AS (
            SELECT a.word AS a, b.word AS b FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
            UNION SELECT cut.word, words.word FROM cut JOIN words ON words.word = cut.rest
            UNION SELECT words.word, cut.word FROM cut JOIN words ON words.word = cut.rest
        ),
        near AS (
            SELECT a AS word, count(*) AS n_near, max(n) AS best_n, arg_min(b, (-n, b)) AS best FROM pairs JOIN words ON words.word = pairs.b GROUP BY a
        ),
        forms AS MATERIALIZED (
            SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 2 * n THEN best END AS form, CASE WHEN best_n >= 2 * n THEN best_n END AS form_n
            FROM words LEFT JOIN near USING (word)
        ),
        chain AS (
            SELECT word, word AS at FROM forms
            UNION ALL SELECT chain.word, forms.form FROM chain JOIN forms ON forms.word = chain.at WHERE forms.form IS NOT NULL
        )
        SELECT f.word, f.form, chain.at AS root, f.n, f.n_near, f.form_n
        FROM forms f JOIN chain ON chain.word = f.word JOIN forms last ON last.word = chain.at AND last.form IS NULL
    """,
}
