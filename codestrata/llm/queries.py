"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.llm import (
    decontaminate,
    license_scan,
    line_labels,
    pfair_mix,
    preference_format,
    quality_rules,
    shard_tree,
    simhash_dedup,
    spelling_forms,
    substring_dedup,
    token_blocks,
    topk_search,
    vector_codes,
)
from codestrata.llm.common import read_table

Query = Callable[[SparkSession, str], DataFrame]


#: The vocabulary file of op9; a path, or None for that of the public tokenizers that are installed.
TOKENIZER: str | None = None
SHARDS = 16


def tokenizer_path() -> str:
    if TOKENIZER:
        return TOKENIZER
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = quality_rules.fit_quality(docs, read_table(spark, sf_dir, "labels"))
    return quality_rules.score_documents(docs, model)


def op2_branch_and_bound_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op3_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    trees = shard_tree.hash_tree(SHARDS), shard_tree.hash_tree(SHARDS + 1)
    return shard_tree.number_shards(read_table(spark, sf_dir, "documents"), *trees)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeated(read_table(spark, sf_dir, "documents"), digest=True)


def op5_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfair_mix.mix_sources(read_table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.find_licenses(read_table(spark, sf_dir, "documents"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = simhash_dedup.link_documents(read_table(spark, sf_dir, "documents"))
    return linked.select("doc_id", "fingerprint", "component_id")


def op8_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as it is against the same with its last answer taken from its neighbour (2k and 2k + 1 are neighbours)."""
    neighbour, odd = F.shiftright("conv_id", 1), F.col("conv_id").bitwiseAND(F.lit(1)) == 1
    pairs = preference_format.swapped_answers(preference_format.pair_conversations(read_table(spark, sf_dir, "conversations"), neighbour, odd))
    rows = preference_format.format_pairs(pairs)
    spans = lambda c: F.concat_ws(",", F.transform(c, lambda s: F.concat_ws(":", s["start"], s["stop"])))
    return rows.withColumn("chosen_learnt", spans("chosen_learnt")).withColumn("rejected_learnt", spans("rejected_learnt"))


def op9_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_blocks.token_digest(read_table(spark, sf_dir, "documents"), tokenizer_path()).drop("file")


def op10_qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op11_spelling_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_forms.spelling_forms(read_table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(read_table(spark, sf_dir, "embeddings"))


def op13_line_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return line_labels.judge_lines(docs, line_labels.fit_lines(docs, read_table(spark, sf_dir, "labels")))


QUERIES: dict[str, Query] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_branch_and_bound_topk": op2_branch_and_bound_topk,
    "op3_hash_tree_shards": op3_hash_tree_shards,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_pfair_mix": op5_pfair_mix,
    "op6_license_scan": op6_license_scan,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_preference_format": op8_preference_format,
    "op9_token_blocks": op9_token_blocks,
    "op10_qgram_decontamination": op10_qgram_decontamination,
    "op11_spelling_forms": op11_spelling_forms,
    "op12_vector_codes": op12_vector_codes,
    "op13_line_labels": op13_line_labels,
}


def _lloyd_sql(rounds: int) -> str:
    """Plain rounds of assignment and averaging over all pairs of a part and an entry, one after the other."""
    assigned = """
        SELECT vec_id, rid, label, p, arg_min(e, d * 256 + e) AS e, min(d) AS d FROM (
            SELECT x.*, b.e, list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM x JOIN {book} b USING (p))
        GROUP BY vec_id, rid, label, p
    """
    steps = ""
    for k in range(rounds):
        steps += f"""
        a{k} AS MATERIALIZED ({assigned.format(book=f"b{k}")}),
        m{k} AS (SELECT p, e, list(m ORDER BY i) AS v FROM (
            SELECT p, e, i, floor(sum(v[i])::DOUBLE / count(*))::BIGINT AS m FROM a{k} JOIN x USING (rid, p), range(1, len(v) + 1) r(i) GROUP BY ALL) GROUP BY p, e),
        b{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM b{k} b LEFT JOIN m{k} m ON m.p = b.p AND m.e = b.e),
        """
    return f"""
        WITH w AS MATERIALIZED (
            SELECT vec_id, label, row_number() OVER (ORDER BY vec_id NULLS LAST) AS rid, list_transform(embedding, lambda c: floor(1024 * c::DOUBLE)::BIGINT) AS v
            FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
        x AS MATERIALIZED (SELECT vec_id, label, rid, p, v[p * len(v) // 4 + 1:(p + 1) * len(v) // 4] AS v FROM w, range(4) t(p)),
        b0 AS MATERIALIZED (SELECT p, rid - 1 AS e, v FROM x WHERE rid <= 256), {steps}
        f AS ({assigned.format(book=f"b{rounds}")}),
        c AS (SELECT rid, vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM f GROUP BY ALL)
        SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
               (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) FROM b{rounds}) AS codebooks_sha256
        FROM c
    """

ORACLE_SQL: dict[str, str] = {
    "op11_spelling_forms": """
        WITH t AS (SELECT list(c ORDER BY i) AS tab FROM (
            SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
        r AS (
            SELECT key, w, count(*) AS n FROM (
                SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\\x{C0}-\\x{FF}]+')) AS w, coalesce(doc_id::VARCHAR, '') || ':' || w AS key FROM documents)
            GROUP BY ALL HAVING length(w) >= 5),
        h AS (
            SELECT w, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(octet_length(encode(key))), lambda i: ('0x' || hex(encode(key))[2 * i + 1:2 * i + 2])::BIGINT)),
                                         lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM r, t),
        s AS (SELECT CASE WHEN h % 97 = 0 THEN w[1:h % length(w)] || w[h % length(w) + 2:] ELSE w END AS word, n FROM h),
        d AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM s WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
        v AS MATERIALIZED (SELECT word, n, i, word[1:i - 1] || word[i + 1:] AS short FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM d)),
        p AS (
            SELECT v.word, d.word AS other, d.n AS m FROM v JOIN d ON d.word = v.short
            UNION SELECT d.word, v.word, v.n FROM v JOIN d ON d.word = v.short
            UNION SELECT a.word, b.word, b.n FROM v a JOIN v b ON a.short = b.short AND a.i = b.i AND a.word <> b.word),
        g AS (SELECT word, count(*) AS n_near, max(m) AS m, min(other) FILTER (rk = 1) AS other FROM (SELECT *, rank() OVER (PARTITION BY word ORDER BY m DESC) AS rk FROM p) GROUP BY word),
        f AS MATERIALIZED (SELECT d.word, d.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * d.n THEN other END AS form, CASE WHEN m >= 2 * d.n THEN m END AS form_n FROM d LEFT JOIN g USING (word)),
        z AS (WITH RECURSIVE u AS (SELECT word, word AS root FROM f UNION ALL SELECT u.word, f.form FROM u JOIN f ON f.word = u.root WHERE f.form IS NOT NULL)
              SELECT u.word, root FROM u JOIN f ON f.word = u.root WHERE f.form IS NULL)
        SELECT word, form, root, n, n_near, form_n FROM f JOIN z USING (word)
    """,
    "op12_vector_codes": _lloyd_sql(vector_codes.ROUNDS),
    "op2_branch_and_bound_topk": """
        WITH v AS MATERIALIZED (
            SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.rid, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
            FROM v q JOIN v c ON q.rid <> c.rid AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0)
        SELECT query_id, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
        FROM s QUALIFY rank <= 10
    """,
    "op8_preference_format": """
        WITH t AS (
            SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS i
            FROM conversations WHERE conv_id IS NOT NULL),
        a AS (SELECT conv_id, i, text AS answer FROM t WHERE role = 'assistant' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
        s AS (
            SELECT conv_id, 'chosen' AS side, i, role, text FROM t
            UNION ALL
            SELECT t.conv_id, 'rejected', t.i, role, CASE WHEN t.i = mine.i THEN other.answer ELSE text END
            FROM t LEFT JOIN a mine USING (conv_id) LEFT JOIN a other ON other.conv_id = xor(t.conv_id, 1)
            WHERE t.i IS DISTINCT FROM mine.i OR other.answer IS NOT NULL),
        r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, side ORDER BY i) AS n, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS line FROM s),
        d AS (
            SELECT coalesce(c.conv_id, j.conv_id) AS conv_id, min(coalesce(c.n, j.n)) AS first_other
            FROM (SELECT * FROM r WHERE side = 'chosen') c FULL JOIN (SELECT * FROM r WHERE side = 'rejected') j ON c.conv_id = j.conv_id AND c.n = j.n
            WHERE (c.role = j.role AND c.text = j.text) IS NOT TRUE GROUP BY ALL),
        p AS (SELECT conv_id, coalesce(any_value(first_other) - 1, count(*) FILTER (side = 'chosen')) AS n_common FROM r LEFT JOIN d USING (conv_id) GROUP BY conv_id),
        o AS (
            SELECT r.*, n_common, n <= n_common AS common,
                   coalesce(sum(length(line)) OVER (PARTITION BY conv_id, side, n <= n_common ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
            FROM r JOIN p USING (conv_id)),
        l AS (
            SELECT *, CASE WHEN role = 'assistant' AND NOT common
                      THEN (before + 13 + length(role))::BIGINT || ':' || (before + length(line))::BIGINT END AS span FROM o)
        SELECT conv_id AS pair_id, conv_id AS chosen_id, any_value(k.there) AS rejected_id, min(n_common)::INTEGER AS n_common,
               coalesce(string_agg(line, '' ORDER BY n) FILTER (side = 'chosen' AND common), '') AS prompt,
               coalesce(string_agg(line, '' ORDER BY n) FILTER (side = 'chosen' AND NOT common), '') AS chosen,
               coalesce(string_agg(span, ',' ORDER BY n) FILTER (side = 'chosen'), '') AS chosen_learnt,
               coalesce(string_agg(line, '' ORDER BY n) FILTER (side = 'rejected' AND NOT common), '') AS rejected,
               coalesce(string_agg(span, ',' ORDER BY n) FILTER (side = 'rejected'), '') AS rejected_learnt
        FROM l LEFT JOIN (SELECT DISTINCT conv_id AS there FROM t) k ON k.there = xor(l.conv_id, 1) GROUP BY conv_id
    """,
    "op4_substring_dedup": r"""
        WITH d AS (
            SELECT row_number() OVER () AS rid, doc_id,
                   list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
            FROM documents),
        h AS (
            SELECT rid, i, md5(array_to_string(ws[i:i + 34], ' ')) AS k
            FROM (SELECT rid, ws, unnest(range(1, len(ws) - 33)) AS i FROM d)),
        hit AS (SELECT rid, i FROM h WHERE k IN (SELECT k FROM h GROUP BY k HAVING count(*) > 1)),
        gone AS (SELECT DISTINCT rid, unnest(range(i, i + 35)) AS i FROM hit),
        kept AS (
            SELECT rid, string_agg(w, ' ' ORDER BY i) AS kept, count(*) AS n
            FROM (SELECT rid, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM d) ANTI JOIN gone USING (rid, i)
            GROUP BY rid)
        SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (rid)
    """,
}
