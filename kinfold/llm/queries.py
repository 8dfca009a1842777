"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from kinfold.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    from kinfold.llm.chat_format import digest, format_chats

    tricky = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    ranks = P.path("byte_bpe_50k.tiktoken")
    return digest(format_chats(turns, ranks, P.PATTERN), ranks, P.PATTERN)


@query
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinfold.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


@query
def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinfold.llm.suffix_dedup import remove_repeats

    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op2_lz_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinfold.llm.lz_dedup import factor_documents

    out = factor_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL["op2_lz_dedup"] = """
WITH docs AS (
    SELECT doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents
), windows AS (
    SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM docs)
), firsts AS (SELECT s, min(doc_id) AS d FROM windows GROUP BY s
), words AS (
    SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM docs
), marked AS (
    SELECT doc_id, i, word, max(CASE WHEN d < doc_id THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone
    FROM words LEFT JOIN windows USING (doc_id, i) LEFT JOIN firsts USING (s)
), kept AS (
    SELECT doc_id, count(*) AS n_words, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS k FROM marked GROUP BY doc_id
)
SELECT doc_id, coalesce(n_words, 0) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)
"""


@query
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinfold.llm.decontaminate import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_SQL["op1_decontaminate"] = """
WITH items AS (
    SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\\pL\\pN]+'), lambda x: x <> '') AS w FROM benchmark
), pieces AS (
    SELECT DISTINCT item_id, ' ' || array_to_string(w[i : i + least(len(w), 5) - 1], ' ') || ' ' AS s
    FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i FROM items WHERE len(w) > 0)
), docs AS (
    SELECT doc_id, ' ' || array_to_string(list_filter(regexp_split_to_array(lower(text), '[^\\pL\\pN]+'), lambda x: x <> ''), ' ') || ' ' AS t FROM documents
), sizes AS (SELECT item_id, count(*) AS n_shingles FROM pieces GROUP BY item_id)
SELECT doc_id, item_id, n_shingles, count(*) AS n_matched, count(*) / n_shingles AS containment
FROM docs JOIN pieces ON contains(t, s) JOIN sizes USING (item_id)
GROUP BY doc_id, item_id, n_shingles HAVING count(*) >= n_shingles * 0.8
"""


@query
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinfold.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinfold.llm.quality_rules import judge, learn

    docs = table(spark, sf_dir, "documents")
    rules = learn(docs, table(spark, sf_dir, "labels"))
    return judge(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinfold.llm.licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


@query
def op7_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinfold.llm.warc import build_derivatives

    out = build_derivatives(table(spark, sf_dir, "pages"))
    return out.select("page_id", "record_type", "record_id", "refers_to", "target_uri", "source_digest", "block_digest", F.length("record").cast("long").alias("n_bytes"), F.sha2("record", 256).alias("record_sha256"))


@query
def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4's counts and base rules by themselves: the part that SQL can express."""
    from kinfold.llm.quality_rules import judge

    return judge(table(spark, sf_dir, "documents"), []).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


ORACLE_SQL["quality_counts"] = """
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents
), windows AS (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS k FROM (SELECT doc_id, i, array_to_string(w[i : i + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d))
), again AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM windows WHERE k > 1) GROUP BY doc_id
), c AS (
    SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words FROM d LEFT JOIN again USING (doc_id)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c
"""


@query
def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6's sizes and targets by themselves: the part that SQL can express."""
    from kinfold.llm.mixing import source_targets, words_in

    sized = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("s"), words_in("text").alias("size"))
    return source_targets(sized, (1, 2, 3), 3).select(F.col("s").alias("source"), "source_size", F.col("docs").alias("n_docs"), "target")


#: Of the sources by cap over weight the first that its share does not exceed sets the level of all that follow.
ORACLE_SQL["mixing_targets"] = """
WITH t AS (
    SELECT source, CAST(sum(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))) AS BIGINT) AS source_size, count(*) AS n_docs FROM documents GROUP BY source
), r AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w, 3.0 * source_size AS most FROM t
), l AS (
    SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(w) OVER (ORDER BY most / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r
), theta AS (SELECT min_by(level, most / w) AS x FROM l WHERE level <= most / w)
SELECT source, source_size, n_docs, CAST(least(x * w, most) AS DOUBLE) AS target FROM l, theta
"""


_CONTROLS = r"<<SYS>>|<</SYS>>|<s>|</s>|\[INST\]|\[/INST\]"

#: Lengths of the template's three marks: 9, 9 and 5 code points.
ORACLE_SQL["op8_chat_format"] = rf"""
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
    SELECT *, 23 + length(role) + length(text) + len(regexp_extract_all(role, '{_CONTROLS}')) + len(regexp_extract_all(text, '{_CONTROLS}')) AS n FROM t
), c AS (
    SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS whole,
        coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss, sum(n) AS formatted FROM e GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(formatted AS BIGINT) AS formatted_chars FROM c
"""

#: Texts as hex digits, two for each byte.
ORACLE_SQL["op5_suffix_dedup"] = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), w AS (SELECT doc_id, s, substr(h, 2 * s + 1, 400) AS v FROM (SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2 - 199, 0))) AS s FROM d)
), again AS (SELECT v FROM w GROUP BY v HAVING count(*) > 1
), m AS (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 200 THEN 0 ELSE 1 END AS new FROM w SEMI JOIN again USING (v)
), g AS (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS k FROM m
), spans AS (SELECT doc_id, k, min(s) AS a, max(s) + 200 AS b FROM g GROUP BY doc_id, k
), pieces AS (
    SELECT doc_id, k, substr(h, 2 * before + 1, 2 * (a - before)) AS p FROM (SELECT doc_id, k, a, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY k), 0) AS before FROM spans) JOIN d USING (doc_id)
    UNION ALL SELECT doc_id, 1000000000, substr(h, 2 * coalesce(last, 0) + 1) FROM d LEFT JOIN (SELECT doc_id, max(b) AS last FROM spans GROUP BY doc_id) USING (doc_id)
), kept AS (SELECT doc_id, sha256(unhex(string_agg(p, '' ORDER BY k))) AS kept_sha256 FROM pieces GROUP BY doc_id)
SELECT doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id) USING (doc_id)
"""
