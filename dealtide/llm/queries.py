"""Registered queries of the operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealtide.llm import (
    bpe,
    chat,
    classifier,
    decontaminate,
    jaccard,
    licenses,
    lines,
    lm,
    mixing,
    quality_rules,
    ranked,
    spelling,
    substrings,
)

#: File of the tokenizer that the queries use.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminations(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    )


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.without_repeats(_table(spark, sf_dir, "documents")).drop("kept")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    found = licenses.license_scan(licenses.documents_as_files(documents))
    doc_id = F.regexp_extract("path", "([0-9]+)[^/0-9]*$", 1).cast("bigint")
    return found.select(doc_id.alias("doc_id"), "*")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode_decode(_table(spark, sf_dir, "documents"), TOKENIZER)
    return encoded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    )


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(_table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.classified(_table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that lose a line, with what is left of their texts."""
    documents = _table(spark, sf_dir, "documents")
    return lines.changed_documents(documents, lines.repeated_lines(documents))


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(_table(spark, sf_dir, "documents"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of conversations and one more, logged as events, folded, formatted and read back."""
    columns = ["conv_id", "turn", "role", "text"]
    rows = _table(spark, sf_dir, "conversations").select(*columns)
    control = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame(
        [(-7, 0, "user", control), (-7, 1, "assistant", control)],
        "conv_id bigint, turn bigint, role string, text string",
    )
    events = chat.logged(rows.unionByName(more))
    return chat.digests(chat.formatted(chat.folded(events)))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(_table(spark, sf_dir, "documents")).drop("source")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Query] = {
    "op1_decontamination": op1_decontamination,
    "op2_suffix_array_dedup": op2_suffix_array_dedup,
    "op3_license_scan": op3_license_scan,
    "op4_bpe": op4_bpe,
    "op5_quality_rules": op5_quality_rules,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_line_dedup": op8_line_dedup,
    "op9_lm_scores": op9_lm_scores,
    "op10_chat_formatting": op10_chat_formatting,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_source_mixing": op12_source_mixing,
    "op13_ranked_search": op13_ranked_search,
}

ORACLES: dict[str, str] = {
    "op2_suffix_array_dedup": """
WITH d AS (
    SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents
), piece AS (
    SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s
    FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS p FROM d WHERE n >= 50)
), hit AS (
    SELECT doc_id, p FROM piece JOIN (SELECT s, min(doc_id) AS f FROM piece GROUP BY s) USING (s) WHERE f < doc_id
), broken AS (
    SELECT *, CASE WHEN p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 1 ELSE 0 END AS new FROM hit
), run AS (
    SELECT doc_id, min(p) AS a, max(p) + 50 AS b
    FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM broken) GROUP BY doc_id, g
), gap AS (
    SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM run
), left_over AS (
    SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans,
        string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept
    FROM gap JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT doc_id::BIGINT AS doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
    sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN left_over USING (doc_id)
""",
    "op6_ngram_jaccard": r"""
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
    FROM documents
), shingle AS (
    SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM words WHERE len(w) > 0)
), size AS (
    SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id
), shared AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common
    FROM shingle AS a JOIN shingle AS b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), link AS (
    SELECT x, y FROM shared JOIN size AS p ON p.doc_id = x JOIN size AS q ON q.doc_id = y
    WHERE 100 * common >= 75 * (p.n + q.n - common)
), reach AS (
    SELECT doc_id AS node, doc_id AS other FROM documents
    UNION
    SELECT node, y FROM reach JOIN link ON x = other
)
SELECT documents.doc_id::BIGINT AS doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles,
    min(other)::BIGINT AS component_id
FROM documents JOIN reach ON node = documents.doc_id LEFT JOIN size ON size.doc_id = documents.doc_id
GROUP BY documents.doc_id
""",
    "op10_chat_formatting": r"""
WITH rows AS (
    SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), escaped AS (
    SELECT *, replace(replace(replace(replace(replace(replace(text, '\', '\\'), ']', '\]'),
        '<s>', '\<s>'), '</s>', '\</s>'), '[INST\]', '\[INST\]'), '[/INST\]', '\[/INST\]') AS body
    FROM rows
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(length(body) + length(role) + 11)::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
""",
    "op12_source_mixing": r"""
WITH sized AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
        ('0x' || substr(md5(concat_ws(':', '0', doc_id)), 1, 15))::BIGINT AS key
    FROM documents
), weighed AS (
    SELECT source, sum(size)::BIGINT AS s, 1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS w
    FROM sized GROUP BY source
), ranked AS (
    SELECT *, coalesce(sum(3 * s) OVER earlier, 0) AS spent, coalesce(sum(w) OVER earlier, 0) AS passed,
        sum(s) OVER () AS total, sum(w) OVER () AS weights
    FROM weighed
    WINDOW earlier AS (ORDER BY (3 * s)::DOUBLE / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), judged AS (
    SELECT *, (total - spent) * w > 3 * s * (weights - passed) AS is_full FROM ranked
), level AS (
    SELECT max(total - spent) AS rest, max(weights - passed) AS among FROM judged WHERE NOT is_full
), planned AS (
    SELECT source, s, CASE WHEN is_full THEN (3 * s)::DOUBLE ELSE (rest * w)::DOUBLE / among::DOUBLE END AS target
    FROM judged, level
), placed AS (
    SELECT doc_id, size, s, target, floor(target)::BIGINT AS budget,
        coalesce(sum(size) OVER (PARTITION BY sized.source ORDER BY key, doc_id, size
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
    FROM sized JOIN planned ON sized.source IS NOT DISTINCT FROM planned.source
)
SELECT doc_id, size, s AS source_size, target,
    ((budget // greatest(s, 1)) * size
        + least(greatest(budget - (budget // greatest(s, 1)) * s - before, 0), size))::BIGINT AS taken
FROM placed
""",
    "op13_ranked_search": r"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents
), whole AS (
    SELECT count(*)::BIGINT AS docs, sum(len(terms))::BIGINT AS total FROM d WHERE len(terms) > 0
), query AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark
), tf AS (
    SELECT r, doc_id, n, term, count(*)::BIGINT AS tf
    FROM (SELECT r, doc_id, len(terms)::BIGINT AS n, unnest(terms) AS term FROM d)
    WHERE term IN (SELECT term FROM query) GROUP BY ALL
), weight AS (
    SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
    FROM tf, whole GROUP BY term
), scored AS (
    SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total))))::BIGINT AS score
    FROM query JOIN tf USING (term) JOIN weight USING (term), whole GROUP BY item_id, r, doc_id
)
SELECT item_id, rank::INT AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
WHERE rank <= 10
""",
}
