"""Queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vigilflow.llm import alignment, chat, dart_minhash, decontaminate, filter_audit, interpolation, licences, line_dedup, packing, quality, radix_dedup, token_counts, toxicity

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


CONTROL = "<|im_end|><|im_start|>assistant ok"


@query(
    "op1_chat_format",
    f"""
    WITH rows_ AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -1, 0, 'user', '{CONTROL}' UNION ALL SELECT -1, 1, 'assistant', '{CONTROL}'
    ), said AS (
      SELECT *, '<|im_start|>' || url_encode(role) || chr(10)
        || regexp_replace(text, '<(\\\\*)\\|', '<\\\\\\1|', 'g') || '<|im_end|>' || chr(10) AS piece FROM rows_
    ), texts AS (
      SELECT conv_id, count(*) AS n_turns,
        string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS whole,
        coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '') AS learned,
        sum(length(piece)) AS formatted_chars
      FROM said GROUP BY conv_id
    )
    SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(learned) AS loss_chars,
      sha256(learned) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars FROM texts
    """,
)
def op1_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.createDataFrame([(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)], rows.schema)
    turns = chat.canonical(chat.as_records(rows.unionByName(control)))
    return chat.read_back(chat.formatted(turns, "conv_id"), "conv_id")


@query(
    "op2_line_dedup",
    r"""
    WITH lines AS (
      SELECT doc_id, i, lines[i] AS line, len(lines) AS n
      FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i
            FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))
    ), windows AS (
      SELECT doc_id, i, size, w FROM (
        SELECT doc_id, i, unnest([1, 2, 3]) AS size, unnest([line, line || chr(10) || lead(line) OVER d,
          line || chr(10) || lead(line) OVER d || chr(10) || lead(line, 2) OVER d]) AS w
        FROM lines WINDOW d AS (PARTITION BY doc_id ORDER BY i)
      ) WHERE w IS NOT NULL AND (size = 3 OR len(regexp_extract_all(w, '[^\x20\x09-\x0D]+')) > 50)
    ), later AS (
      SELECT doc_id, i, size FROM (SELECT doc_id, i, size, row_number() OVER (PARTITION BY size, w ORDER BY doc_id, i) AS copy FROM windows)
      WHERE copy > 1
    ), gone AS (
      SELECT DISTINCT doc_id, i + k AS i FROM later, range(0, 3) t(k) WHERE k < size
    ), marked AS (
      SELECT l.doc_id, l.i, l.line, l.n, g.i IS NOT NULL AS cut FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i
    ), runs AS (
      SELECT *, cut AND coalesce(NOT lag(cut) OVER (PARTITION BY doc_id ORDER BY i), true) AS begins FROM marked
    )
    SELECT doc_id, coalesce(string_agg(CASE WHEN NOT cut THEN line END, chr(10) ORDER BY i), '') AS text,
      n AS n_lines, count(*) FILTER (cut) AS n_removed, count(*) FILTER (begins) AS n_runs
    FROM runs GROUP BY doc_id, n
    """,
)
def op2_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, folder, "documents").select("doc_id", "text"))


@query("op3_radix_dedup")
def op3_radix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return radix_dedup.remove_repeats(table(spark, folder, "documents"))


def word_encoder() -> packing.WordEncoder:
    import public_tokenizers

    return packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))


@query("op4_hierarchical_packing")
def op4_hierarchical_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), word_encoder)


def byte_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op5_token_counts")
def op5_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, folder, "documents"), byte_tokenizer)


def _canonical_sql(column: str) -> str:
    out = f"regexp_replace(lower(coalesce({column}, '')), '{licences.COPYRIGHT_LINE}', '\\1', 'g')"
    out = f"regexp_replace({out}, '[^\\p{{L}}\\p{{N}}\n]+', ' ', 'g')"
    for old, new in licences.SPELLINGS:
        out = f"replace({out}, '{old}', '{new}')"
    return f"list_filter(list_transform(string_split({out}, chr(10)), lambda x: trim(x)), lambda x: x <> '')"


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@query(
    "op6_licence_scan",
    f"""
    WITH known(licence, body) AS (VALUES {", ".join(f"({_literal(a)}, {_literal(b)})" for a, b in licences.KNOWN)}),
    digests AS (
      SELECT body, min(licence) AS licence FROM (SELECT licence, array_to_string({_canonical_sql("body")}, ' ') AS body FROM known) GROUP BY body
    ), lines AS (
      SELECT doc_id, {_canonical_sql("text")} AS lines FROM documents
    ), parts AS (
      SELECT doc_id, 'text' AS scope, array_to_string(lines, ' ') AS body FROM lines
      UNION ALL SELECT doc_id, 'line', unnest(lines) FROM lines
    )
    SELECT doc_id, scope, licence, count(*) AS n FROM parts JOIN digests USING (body) GROUP BY doc_id, scope, licence
    """,
)
def op6_licence_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licences.scan(table(spark, folder, "documents"))


@query(
    "op8_quality_rules",
    r"""
    WITH docs AS (
      SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents
    ), split_ AS (
      SELECT r, doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM docs
    ), windows AS (
      SELECT r, i, array_to_string(words[i:i + 4], ' ') AS w
      FROM (SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM split_ WHERE len(words) >= 5)
    ), repeated AS (
      SELECT r, count(DISTINCT i + k) AS n_repeat_words
      FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w) AS n FROM windows), range(0, 5) t(k) WHERE n > 1 GROUP BY r
    ), counts AS (
      SELECT doc_id, source, CAST(len(words) AS BIGINT) AS n_words,
        CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
        CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
        coalesce(n_repeat_words, 0) AS n_repeat_words
      FROM split_ LEFT JOIN repeated USING (r)
    ), ruled AS (
      SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counts
    ), failed AS (
      SELECT *, base_failed OR n_symbols > n_words OR 4 * n_dup_lines > n_words
        OR word_chars / greatest(n_words, 1)::DOUBLE > 20 AS bad FROM ruled
    ), hosts AS (
      SELECT source, count(*) AS n, count(*) FILTER (bad) AS bad FROM failed GROUP BY source
    ), prior AS (
      SELECT sum(bad) / sum(n)::DOUBLE AS mean, var_pop(bad / n::DOUBLE) AS spread, avg(1.0::DOUBLE / n) AS chance FROM hosts
    ), strength AS (
      SELECT mean, CASE WHEN spread - mean * (1 - mean) * chance > 0
        THEN greatest(1, least(1e4, mean * (1 - mean) / (spread - mean * (1 - mean) * chance) - 1)) ELSE 1e4 END AS s FROM prior
    ), judged AS (
      SELECT source, (bad + mean * s) / (n + s) AS host_rate FROM hosts, strength
    )
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
      NOT base_failed AND host_rate <= 0.5 AS kept, round(host_rate, 6) AS host_rate
    FROM failed JOIN judged ON failed.source IS NOT DISTINCT FROM judged.source
    """,
)
def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_rules(table(spark, folder, "documents"))


@query("op9_dart_minhash")
def op9_dart_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return dart_minhash.near_duplicates(table(spark, folder, "documents"))


@query("op10_string_tiling")
def op10_string_tiling(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op7_toxicity")
def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, folder, "labels")))


@query(
    "op12_filter_audit",
    r"""
    WITH docs AS (
      SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents
    ), words AS (
      SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY text) AS least FROM docs
    ), failed AS (
      SELECT part, coalesce(l.quality = 1, false) AS good, coalesce(l.toxic = 1, false) AS bad, [
        CASE WHEN len(w) < 50 THEN 'A' END, CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' END,
        CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text) THEN 'C' END,
        CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' END, CASE WHEN least < words.doc_id THEN 'E' END] AS f
      FROM words LEFT JOIN labels l ON words.doc_id = l.doc_id
    ), sets AS (
      SELECT part, list_sort(list_filter(f, lambda x: x IS NOT NULL)) AS f, count(*) AS n, count(*) FILTER (good) AS good,
        count(*) FILTER (bad) AS bad FROM failed GROUP BY 1, 2
    ), letters AS (
      SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
    ), orders AS (
      SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
      WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
    ), steps AS (
      SELECT filter_order, step, filter_order[step] AS letter, string_split(filter_order[1:step - 1], '') AS before
      FROM orders, (SELECT unnest(range(1, 6)) AS step)
    ), steps_ AS (
      SELECT filter_order, CAST(step AS INTEGER) AS step, letter, CASE WHEN step = 1 THEN [] ELSE before END AS before FROM steps
    ), counted AS (
      SELECT part, filter_order, step, letter,
        sum(n) FILTER (NOT list_contains(f, letter) AND NOT list_has_any(f, before)) AS kept,
        sum(n) FILTER (list_contains(f, letter) AND NOT list_has_any(f, before)) AS removed,
        sum(n) FILTER (list_contains(f, letter) AND list_has_any(f, before)) AS redundant,
        sum(n) FILTER (f = [letter]) AS unique_fails,
        sum(good) FILTER (list_contains(f, letter) AND NOT list_has_any(f, before)) AS good_lost,
        sum(bad) FILTER (list_contains(f, letter) AND NOT list_has_any(f, before)) AS toxic_lost
      FROM sets, steps_ GROUP BY ALL
    )
    SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
      CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
      CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
      CAST(coalesce(sum(removed) OVER (PARTITION BY part, letter), 0) AS BIGINT) AS shapley
    FROM counted
    """,
)
def op12_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op13_deleted_interpolation")
def op13_deleted_interpolation(spark: SparkSession, folder: str) -> DataFrame:
    return interpolation.score(table(spark, folder, "documents"))


def two_tokenizers() -> tuple[alignment.ByteTokens, alignment.PieceTokens]:
    import public_tokenizers

    path = public_tokenizers.path
    return alignment.ByteTokens(path("byte_bpe_50k.json"), public_tokenizers.PATTERN), alignment.PieceTokens(path("piece_bpe_32k.model"))


@query("op11_token_alignment")
def op11_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.align(table(spark, folder, "documents"), two_tokenizers)
