"""The queries of this package, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.line_dedup import remove_boilerplate

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return remove_boilerplate(docs).select("doc_id", "n_lines", "n_removed", "text")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.substring_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), window=35)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.packing import pack

    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.secrets import find_secrets

    return find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), k=3, part=85, whole=100)


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.embedding_dedup import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"), cosine=0.98)


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.html_text import extract_main_text

    return extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.toxicity import score_toxicity

    return score_toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.tokens import count_tokens

    return count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.ranked_search import search

    return search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"), k=20)


def op12_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.transducer import encode

    return encode(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.manifest import digest, manifest

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    # Every second row, by its id, is held against the manifest without its line breaks.
    tampered = (F.crc32(F.col("doc_id").cast("string")) % 2 == 0) & F.contains("text", F.lit("\n"))
    offered = F.when(tampered, digest("doc_id", "source", "lang", "n_chars", F.replace("text", F.lit("\n"), F.lit(""))))
    return manifest(docs, offered=offered, with_proof=False)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op3_packing": op3_packing,
    "op4_secret_scans": op4_secret_scans,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op6_embedding_near_dedup": op6_embedding_near_dedup,
    "op7_html_extraction": op7_html_extraction,
    "op8_toxicity": op8_toxicity,
    "op9_token_counts": op9_token_counts,
    "op2_substring_dedup": op2_substring_dedup,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
    "op11_ranked_search": op11_ranked_search,
    "op12_bpe_round_trip": op12_bpe_round_trip,
    "op13_merkle_manifest": op13_merkle_manifest,
    "pipeline": pipeline,
}

ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": r"""
        WITH d AS (SELECT doc_id, source, string_split(text, chr(10)) AS lines, row_number() OVER () AS rn FROM documents),
        l AS (SELECT rn, doc_id, source, unnest(lines) AS line, generate_subscripts(lines, 1) AS place FROM d),
        k AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS t FROM l),
        b AS (SELECT t, min(doc_id) AS first FROM k WHERE t <> '' GROUP BY t HAVING count(DISTINCT source) >= 10),
        j AS (SELECT k.*, coalesce(k.doc_id <> b.first, FALSE) AS gone FROM k LEFT JOIN b ON k.t = b.t)
        SELECT doc_id, count(*) FILTER (t <> '') AS n_lines, count(*) FILTER (gone) AS n_removed,
               coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '') AS text
        FROM j GROUP BY rn, doc_id
    """,
    "op11_ranked_search": r"""
        WITH d AS (SELECT row_number() OVER () AS rn, doc_id, text FROM documents),
        t AS (SELECT rn, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
        size AS (SELECT count(DISTINCT rn) AS docs, count(*) AS total FROM t),
        n AS (SELECT rn, count(*) AS n FROM t GROUP BY rn),
        tf AS (SELECT rn, doc_id, term, count(*) AS tf FROM t GROUP BY rn, doc_id, term),
        w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, size GROUP BY term),
        q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
        s AS (
          SELECT item_id, doc_id, rn, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total)))) AS BIGINT) AS score
          FROM q JOIN tf USING (term) JOIN w USING (term) JOIN n USING (rn), size GROUP BY item_id, doc_id, rn),
        r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
        SELECT * FROM r WHERE rank <= 20
    """,
    "op13_merkle_manifest": r"""
        WITH RECURSIVE bits AS (
          SELECT DISTINCT doc_id, list_reduce(list_prepend(4294967295::UBIGINT, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ord(c)::UBIGINT, 256, 256, 256, 256, 256, 256, 256, 256]))),
            lambda a, x: CASE WHEN x < 256 THEN xor(a, x) ELSE xor(a >> 1, CASE WHEN a % 2 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END) END) % 2 = 1 AS even FROM documents),
        head AS (
          SELECT d.doc_id, d.source, d.text, even, concat(coalesce(concat(strlen(CAST(d.doc_id AS VARCHAR)), ':', d.doc_id), '-'), coalesce(concat(strlen(d.source), ':', d.source), '-'),
            coalesce(concat(strlen(lang), ':', lang), '-'), coalesce(concat(strlen(CAST(n_chars AS VARCHAR)), ':', n_chars), '-')) AS head
          FROM documents d JOIN bits USING (doc_id)),
        leaf AS (
          SELECT doc_id, source, sha256(concat(head, coalesce(concat(strlen(text), ':', text), '-'))) AS leaf,
            sha256(concat(head, coalesce(concat(strlen(CASE WHEN even THEN replace(text, chr(10), '') ELSE text END), ':', CASE WHEN even THEN replace(text, chr(10), '') ELSE text END), '-'))) AS offered
          FROM head),
        grown AS (
          SELECT source, 0 AS up, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS place, leaf AS hash, count(*) OVER (PARTITION BY source) AS total FROM leaf
          UNION ALL
          SELECT source, up + 1, place // 3, sha256(string_agg(hash, '' ORDER BY place)), (total + 2) // 3 FROM grown WHERE total > 1 GROUP BY source, up, place // 3, total),
        runs AS (SELECT source, up, place // 3 AS run, list(hash ORDER BY place) AS held FROM grown WHERE total > 1 GROUP BY ALL),
        path AS (
          SELECT doc_id, source, leaf, 0 AS up, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS place, '' AS proof, offered AS folded FROM leaf
          UNION ALL
          SELECT doc_id, p.source, leaf, p.up + 1, place // 3, concat(proof, array_to_string(held[1 : place % 3], ''), array_to_string(held[place % 3 + 2 : 3], '')),
            sha256(concat(array_to_string(held[1 : place % 3], ''), folded, array_to_string(held[place % 3 + 2 : 3], '')))
          FROM path p JOIN runs r ON p.up = r.up AND p.place // 3 = r.run AND p.source IS NOT DISTINCT FROM r.source),
        over AS (
          SELECT 0 AS up, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, hash, count(*) OVER () AS total FROM grown WHERE total = 1
          UNION ALL
          SELECT up + 1, place // 3, sha256(string_agg(hash, '' ORDER BY place)), (total + 2) // 3 FROM over WHERE total > 1 GROUP BY up, place // 3, total),
        over_runs AS (SELECT up, place // 3 AS run, list(hash ORDER BY place) AS held FROM over WHERE total > 1 GROUP BY ALL),
        seat AS (SELECT source, hash AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place FROM grown WHERE total = 1),
        rest AS (
          SELECT doc_id, leaf, subroot, 0 AS up, s.place, proof, folded FROM path p JOIN seat s ON p.source IS NOT DISTINCT FROM s.source
          WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE p.up = r.up AND p.place // 3 = r.run AND p.source IS NOT DISTINCT FROM r.source)
          UNION ALL
          SELECT doc_id, leaf, subroot, up + 1, place // 3, concat(proof, array_to_string(held[1 : place % 3], ''), array_to_string(held[place % 3 + 2 : 3], '')),
            sha256(concat(array_to_string(held[1 : place % 3], ''), folded, array_to_string(held[place % 3 + 2 : 3], '')))
          FROM rest p JOIN over_runs r USING (up) WHERE p.place // 3 = r.run),
        top AS (SELECT hash AS root, up FROM over WHERE total = 1)
        SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified FROM rest JOIN top USING (up)
    """,
}
