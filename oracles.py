"""DuckDB SQL that each query in ``__spark_entry__`` is checked against.

The SQL is written from the definitions, not from the Spark code. Shared parts
are common table expressions put together by the helpers below.
"""

from __future__ import annotations

VECTOR_DIM = 64
SMALL_VECTOR_DIM = 16
TEXT_DIM = 256
TFIDF_DIM = 256
# The caller's instructions to a generator.
SYSTEM_PROMPT = "You get a question and a few numbered texts. Reply in prose, numbers in brackets."
SMALL_TEXT_DIM = 64
CELLS = 16
PROBES = 4
COMPARED_PROBES = (1, 2, 4, 8)
SIGN_BITS = 4
CORPUS_SAMPLE = 12
QUERY_SAMPLE = 100
FIT_SAMPLE = 256
FIT_SEED = 7
LINSPACE_SAMPLE = 1000
LABEL_THRESHOLD = 1500.0
OUT_OF_DOMAIN = 1_000_000_000
SEED = 20260714

SPACE = r"[[:space:]\x1c-\x1f\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def key(column: str, seed: int = SEED) -> str:
    return f"(({column}::BIGINT * 1103515245 + {seed}) % 2147483647)"


def strip(text: str) -> str:
    return (
        f"trim(regexp_replace(regexp_replace({text}, '<[^>]+>', ' ', 'g'), "
        "'[[:space:]]+', ' ', 'g'))"
    )


def squeeze(text: str) -> str:
    return f"trim(regexp_replace({text}, '{SPACE}+', ' ', 'g'))"


def clean(text: str) -> str:
    """Decodes the entities that the test pages contain; '&amp;' comes last."""
    for entity, plain in [
        ("&quot;", "'\"'"),
        ("&lt;", "'<'"),
        ("&gt;", "'>'"),
        ("&#39;", "''''"),
        ("&nbsp;", "chr(160)"),
        ("&copy;", "chr(169)"),
        ("&middot;", "chr(183)"),
    ]:
        text = f"replace({text}, '{entity}', {plain})"
    return squeeze(f"regexp_replace({text}, '&amp;?', '&', 'g')")


def words(text: str) -> str:
    return (
        rf"list_filter(string_split_regex(lower({text}), '[^\p{{L}}\p{{N}}]+'), "
        "lambda w: w <> '')"
    )


def word_set(text: str) -> str:
    return f"list_distinct({words(text)})"


def entries(source: str) -> str:
    """Non-zero entries of ``source(doc_id, e)``."""
    return f"""
        SELECT doc_id, dim, round(weight::DOUBLE, 6) AS weight FROM (
            SELECT doc_id, unnest(e) AS weight, unnest(range(len(e))) AS dim FROM {source}
        ) WHERE weight <> 0"""


def encode(name: str, source: str, dim: int = TEXT_DIM) -> str:
    """CTEs that encode ``source(id, text)`` into ``name(id, e)``."""
    return f"""
    {name}_words AS (SELECT id, unnest({words("text")}) AS w FROM {source}),
    {name}_counts AS (
        SELECT id, ('0x' || substr(md5(w), 1, 4))::INTEGER % {dim} AS slot, count(*) AS n
        FROM {name}_words GROUP BY ALL),
    {name}_all AS (
        SELECT s.id, r.slot, coalesce(c.n, 0) + CASE WHEN r.slot = 0 THEN 1 ELSE 0 END AS n
        FROM (SELECT id FROM {source}) s CROSS JOIN (SELECT unnest(range({dim})) AS slot) r
        LEFT JOIN {name}_counts c ON c.id = s.id AND c.slot = r.slot),
    {name} AS (
        SELECT id, list((n / norm)::FLOAT ORDER BY slot) AS e FROM (
            SELECT id, slot, n::DOUBLE AS n,
                   sqrt(sum(n * n) OVER (PARTITION BY id)::DOUBLE) AS norm FROM {name}_all)
        GROUP BY id)"""


def fold(name: str, source: str, dim: int, small: int) -> str:
    """CTEs that sum neighbouring dimensions of ``source(id, e)`` and normalise."""
    return f"""
    {name}_sums AS (
        SELECT id, slot // {dim // small} AS slot, sum(x::DOUBLE) AS x FROM (
            SELECT id, unnest(e) AS x, unnest(range({dim})) AS slot FROM {source})
        GROUP BY ALL),
    {name} AS (
        SELECT id, list((x / norm)::FLOAT ORDER BY slot) AS e FROM (
            SELECT id, slot, x, sqrt(sum(x * x) OVER (PARTITION BY id)) AS norm
            FROM {name}_sums)
        GROUP BY id)"""


def dot(a: str, b: str) -> str:
    return f"round(list_inner_product({a}::DOUBLE[], {b}::DOUBLE[]), 9)"


def best_k(name: str, pairs: str, k: int) -> str:
    """CTE with the top k of a query over (query_id, doc_id, score)."""
    return f"""
    {name} AS (
        SELECT query_id, rank, doc_id, score FROM (
            SELECT *, row_number() OVER (
                PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
            FROM ({pairs}))
        WHERE rank <= {k})"""


def topk(name: str, queries: str, documents: str, k: int) -> str:
    return best_k(
        name,
        f"""SELECT q.id AS query_id, d.id AS doc_id, {dot("q.e", "d.e")} AS score
            FROM {queries} q CROSS JOIN {documents} d""",
        k,
    )


def cells(name: str, documents: str) -> str:
    """CTEs ``name_pivots(cell, e)`` and ``name_near(id, cell, place)``."""
    return f"""
    {name}_pivots AS (
        SELECT row_number() OVER (ORDER BY id) - 1 AS cell, e FROM (
            SELECT id, e FROM {documents} ORDER BY {key("id")}, id LIMIT {CELLS})),
    {name}_near AS (
        SELECT id, cell, row_number() OVER (PARTITION BY id ORDER BY score DESC, cell) AS place
        FROM (SELECT d.id, p.cell, {dot("d.e", "p.e")} AS score
              FROM {documents} d CROSS JOIN {name}_pivots p))"""


def cell_topk(name: str, base: str, queries: str, documents: str, probes: int, k: int) -> str:
    """Top k within the probed cells; queries and documents share their pivots."""
    return best_k(
        name,
        f"""SELECT q.id AS query_id, d.id AS doc_id, {dot("q.e", "d.e")} AS score
            FROM {queries} q
            JOIN {base}_qnear qn ON qn.id = q.id AND qn.place <= {probes}
            JOIN {base}_near dn ON dn.cell = qn.cell AND dn.place = 1
            JOIN {documents} d ON d.id = dn.id""",
        k,
    )


def query_cells(base: str, queries: str) -> str:
    return f"""
    {base}_qnear AS (
        SELECT id, cell, row_number() OVER (PARTITION BY id ORDER BY score DESC, cell) AS place
        FROM (SELECT q.id, p.cell, {dot("q.e", "p.e")} AS score
              FROM {queries} q CROSS JOIN {base}_pivots p))"""


RANKING = "query_id, rank, doc_id, score"

VECTORS = "v AS (SELECT vec_id AS id, embedding AS e FROM embeddings)"

QUESTIONS = """
    first_turn AS (
        SELECT conv_id, text FROM conversations WHERE role = 'user'
        QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1),
    raw_questions AS (
        SELECT conv_id AS question_id, (length(text) % 11)::INTEGER AS question_score,
               regexp_extract(text, '^[^\\n]*') AS title_html,
               '<p>' || text || '</p>' AS question_html
        FROM first_turn)"""

ANSWERS = """
    raw_answers AS (
        SELECT conv_id AS question_id, conv_id * 1000 + turn AS answer_id,
               (length(text) % 7)::INTEGER AS answer_score,
               '<p>' || replace(text, chr(10), '</p>' || chr(10) || '<p>') || '</p>' AS answer_html
        FROM conversations WHERE role = 'assistant'),
    best AS (
        SELECT * FROM raw_answers
        QUALIFY row_number() OVER (
            PARTITION BY question_id ORDER BY answer_score DESC, answer_id) = 1)"""

CORPUS = f"""{QUESTIONS}, {ANSWERS},
    corpus AS (
        SELECT row_number() OVER (ORDER BY {key("question_id")}, question_id) - 1 AS doc_id,
               question_id, answer_id,
               {strip("title_html")} AS title, {strip("question_html")} AS question_body,
               {strip("answer_html")} AS answer, question_score, answer_score,
               'https://stackoverflow.com/questions/' || question_id::VARCHAR AS url
        FROM raw_questions JOIN best USING (question_id))"""

PAGES = f"""
    page_queries AS (
        SELECT page_id AS id, {clean("regexp_extract(html, '<title>([^<]*)</title>', 1)")} AS text
        FROM pages),
    page_documents AS (
        SELECT page_id AS id, {clean(strip("regexp_replace(html, '(?s)<head>.*?</head>', ' ', 'g')"))} AS text
        FROM pages), {encode("pq", "page_queries")}, {encode("pd", "page_documents")}"""

KNOWN_ITEM = f"""{PAGES}, {topk("hits", "pq", "pd", 10)},
    ranks AS (
        SELECT q.id AS query_id, q.text AS query, q.id AS relevant_doc_id,
               coalesce((SELECT min(rank) FROM hits h
                         WHERE h.query_id = q.id AND h.doc_id = q.id), 0)::BIGINT AS rank
        FROM page_queries q)"""

QUALITY = """
    count(*) AS queries,
    round(avg(CASE WHEN rank BETWEEN 1 AND 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall_at_1,
    round(avg(CASE WHEN rank BETWEEN 1 AND 5 THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall_at_5,
    round(avg(CASE WHEN rank BETWEEN 1 AND 10 THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall_at_10,
    round(avg(CASE WHEN rank BETWEEN 1 AND 10 THEN 1.0::DOUBLE / rank ELSE 0 END), 6)
        AS mrr_at_10,
    round(avg(CASE WHEN rank BETWEEN 1 AND 10 THEN 1.0::DOUBLE / log2(rank + 1) ELSE 0 END), 6)
        AS ndcg_at_10"""

LEXICAL = f"""
    split_pages AS (SELECT id, {words("text")} AS ws FROM page_documents),
    pages_held AS (SELECT count(*)::DOUBLE AS n, avg(len(ws)) AS mean FROM split_pages),
    counted_words AS (
        SELECT id, word, size, count(*) AS tf
        FROM (SELECT id, unnest(ws) AS word, len(ws) AS size FROM split_pages)
        GROUP BY id, word, size),
    holders AS (SELECT word, count(*)::DOUBLE AS df FROM counted_words GROUP BY word),
    impacts AS (
        SELECT id, word, floor(
            ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE
            / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * size / mean)) * 1000000
        )::BIGINT AS impact
        FROM counted_words JOIN holders USING (word) CROSS JOIN pages_held),
    asked_words AS (
        SELECT id AS query_id, unnest({word_set("text")}) AS word FROM page_queries),
    {best_k(
        "lexical_hits",
        """SELECT query_id, id AS doc_id, sum(impact)::DOUBLE / 1000000 AS score
           FROM asked_words JOIN impacts USING (word)
           GROUP BY query_id, id HAVING sum(impact) > 0""",
        10,
    )}"""

LABELLED = "labelled AS (SELECT quality, n_chars FROM labels JOIN documents USING (doc_id))"

QUESTION_SET = f"""
    questions AS (
        SELECT question_id AS query_id, title AS query, true AS in_domain FROM corpus
        UNION ALL
        SELECT item_id + {OUT_OF_DOMAIN}, {squeeze("text")}, false FROM benchmark),
    drafts AS (
        SELECT question_id AS query_id,
               answer || ' [' || (question_id % 5)::VARCHAR || ']' AS draft FROM corpus
        UNION ALL
        SELECT item_id + {OUT_OF_DOMAIN}, text || ' [' || (item_id % 5)::VARCHAR || ']'
        FROM benchmark)"""

CANDIDATES = f"""{CORPUS}, {QUESTION_SET},
    aq AS (SELECT query_id AS id, query AS text FROM questions),
    ad AS (SELECT doc_id AS id, question_body AS text FROM corpus),
    {encode("aqv", "aq")}, {encode("adv", "ad")}, {topk("nearest", "aqv", "adv", 40)},
    candidates AS (
        SELECT n.query_id, q.query, n.rank, n.doc_id, n.score AS vector_similarity,
               {clean("c.title")} AS title, {clean("c.question_body")} AS question_body,
               {clean("c.answer")} AS answer, c.answer_score, c.url
        FROM nearest n JOIN corpus c USING (doc_id) JOIN questions q USING (query_id)),
    scored AS (
        SELECT *, CASE WHEN len(qw) > 0
                       THEN len(list_intersect(qw, dw))::DOUBLE / len(qw) ELSE 0 END
                  AS reranker_score
        FROM (SELECT *, {word_set("query")} AS qw,
                     {word_set("title || chr(10) || question_body")} AS dw FROM candidates))"""

SOURCED = f"""{CANDIDATES},
    reranked AS (
        SELECT * FROM (
            SELECT *, row_number() OVER (
                PARTITION BY query_id ORDER BY final_score DESC, doc_id) AS source_rank
            FROM (SELECT *, reranker_score
                         + 0.03::DOUBLE * ln(1 + greatest(answer_score, 0)) AS final_score
                  FROM scored))
        WHERE source_rank <= 3),
    first_source AS (SELECT * FROM reranked WHERE source_rank = 1),
    contexts AS (
        SELECT query_id, string_agg(
            '[' || source_rank::VARCHAR || ']' || chr(10) || 'Title: ' || title || chr(10)
            || 'Question: ' || substring(question_body, 1, 700) || chr(10)
            || 'Answer: ' || substring(answer, 1, 1400) || chr(10) || 'URL: ' || url,
            chr(10) || chr(10) ORDER BY source_rank) AS context
        FROM reranked GROUP BY query_id)"""


def extract(answer: str) -> str:
    split = f"list_filter(string_split({clean(answer)}, ' '), lambda w: w <> '')"
    return (
        f"(array_to_string(list_slice({split}, 1, 140), ' ') || "
        f"CASE WHEN len({split}) > 140 THEN ' ...' ELSE '' END || ' [1]')"
    )


LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"


def measured(name: str, source: str, answer: str, count: str) -> str:
    """CTEs that add coverage and validity of ``answer`` to ``source``."""
    return f"""
    {name}_parts AS (
        SELECT *, list_filter(
            list_transform(string_split_regex({answer}, '{LINE_END}'),
                           lambda p: regexp_replace(p, '^{SPACE}+|{SPACE}+$', '', 'g')),
            lambda p: length(p) >= 15) AS parts
        FROM {source}),
    {name}_numbers AS (
        SELECT *, list_transform(
            flatten(list_transform(parts, lambda p: regexp_extract_all(p, '\\[([0-9]+)\\]', 1))),
            lambda t: try_cast(t AS BIGINT)) AS numbers,
            len(list_filter(parts, lambda p: regexp_matches(p, '\\[[0-9]+\\]'))) AS cited
        FROM {name}_parts),
    {name} AS (
        SELECT * EXCLUDE (parts, numbers, cited),
            CASE WHEN len(parts) > 0 THEN cited::DOUBLE / len(parts) ELSE 0 END AS coverage,
            CASE WHEN len(numbers) > 0
                 THEN len(list_filter(numbers, lambda n: n BETWEEN 1 AND {count}))::DOUBLE
                      / len(numbers) ELSE 0 END AS validity
        FROM {name}_numbers)"""


AUDIT = f"""{SOURCED},
    drafted AS (
        SELECT q.query_id, q.query, q.in_domain, f.reranker_score AS top_score,
               regexp_replace(d.draft, '^{SPACE}+|{SPACE}+$', '', 'g') AS draft,
               {extract("f.answer")} AS extracted,
               (SELECT count(*) FROM reranked r WHERE r.query_id = q.query_id) AS n_sources,
               (SELECT string_agg(r.doc_id::VARCHAR, ',' ORDER BY r.source_rank)
                FROM reranked r WHERE r.query_id = q.query_id) AS source_ids
        FROM questions q JOIN drafts d USING (query_id) JOIN first_source f USING (query_id)),
    {measured("first_pass", "drafted", "draft", "n_sources")},
    decided AS (
        SELECT * EXCLUDE (coverage, validity), coverage AS coverage_1, validity AS validity_1,
               (validity < 1.0 OR coverage < 0.5) AS used_fallback
        FROM first_pass),
    {measured("second_pass", "decided", "extracted", "n_sources")},
    audited AS (
        SELECT query_id, query, in_domain, top_score, source_ids, used_fallback,
               CASE WHEN used_fallback THEN extracted ELSE draft END AS answer,
               CASE WHEN used_fallback THEN coverage ELSE coverage_1 END AS citation_coverage,
               CASE WHEN used_fallback THEN validity ELSE validity_1 END AS citation_validity
        FROM second_pass),
    records AS (
        SELECT query_id, query, in_domain, top_score, source_ids,
               top_score < 0.449093 AS abstained,
               CASE WHEN top_score < 0.449093
                    THEN 'I could not find enough reliable evidence in the Stack Overflow collection.'
                    ELSE answer END AS answer,
               used_fallback AND NOT top_score < 0.449093 AS used_fallback,
               CASE WHEN NOT top_score < 0.449093 THEN citation_coverage END AS citation_coverage,
               CASE WHEN NOT top_score < 0.449093 THEN citation_validity END AS citation_validity
        FROM audited)"""

RATES = """
    CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision,
    CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall"""

THRESHOLDS = f"""{LABELLED},
    per_score AS (
        SELECT n_chars::DOUBLE AS threshold, sum(quality)::DOUBLE AS pos,
               sum(1 - quality)::DOUBLE AS neg FROM labelled GROUP BY 1),
    running AS (
        SELECT threshold,
               sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
               (SELECT sum(pos) FROM per_score) - sum(pos) OVER w AS fn,
               (SELECT sum(neg) FROM per_score) - sum(neg) OVER w AS tn
        FROM per_score WINDOW w AS (ORDER BY threshold DESC)),
    rated AS (
        SELECT threshold, (tp + tn) / (tp + fp + fn + tn) AS accuracy, {RATES} FROM running),
    curve AS (
        SELECT threshold, accuracy, precision, recall,
               CASE WHEN precision + recall > 0
                    THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1
        FROM rated)"""


def _search_sql() -> dict[str, str]:
    exact = f"WITH {VECTORS}, {topk('hits', 'v', 'v', 10)} SELECT {RANKING} FROM hits"

    def probed(n: int) -> str:
        return f"""WITH {VECTORS}, {cells("c", "v")}, {query_cells("c", "v")},
            {cell_topk("hits", "c", "v", "v", n, 10)} SELECT {RANKING} FROM hits"""

    side = f"""CASE WHEN ('0x' || substr(md5(b.bit::VARCHAR || ':' || x.d::VARCHAR), 1, 1))
        ::INTEGER < 8 THEN x.x ELSE -x.x END"""
    lsh = f"""WITH {VECTORS},
        x AS (SELECT id, unnest(e)::DOUBLE AS x, unnest(range({VECTOR_DIM})) AS d FROM v),
        bits AS (SELECT unnest(range({SIGN_BITS})) AS bit),
        sides AS (
            SELECT x.id, b.bit, round(sum({side}), 9) AS side FROM x CROSS JOIN bits b
            GROUP BY ALL),
        codes AS (
            SELECT id, sum(CASE WHEN side >= 0 THEN 1 << bit ELSE 0 END)::BIGINT AS code
            FROM sides GROUP BY id),
        {best_k("hits", f'''
            SELECT q.id AS query_id, d.id AS doc_id, {dot("q.e", "d.e")} AS score
            FROM v q JOIN codes qc ON qc.id = q.id
            JOIN codes dc ON bit_count(xor(qc.code, dc.code)) <= 1
            JOIN v d ON d.id = dc.id''', 10)}
        SELECT {RANKING} FROM hits"""
    return {
        "exact_topk": exact,
        "exact_topk_grid": exact,
        "ivf_topk": probed(PROBES),
        "ivf_topk_all_cells": exact,
        "ivf_stored_index": probed(PROBES),
        "ivf_kmeans_all_cells": exact,
        "lsh_topk": lsh,
        "pruned_topk": exact,
        "quantized_topk_all": exact,
        "lsh_tables_all": exact,
        "lsh_rows_read": """SELECT vec_id AS query_id, 32 AS buckets,
            2 * count(*) OVER () AS rows_read FROM embeddings""",
    }


def _corpus_sql() -> dict[str, str]:
    whole = f"WITH {CORPUS} SELECT * FROM corpus"
    numbered = f"""
        SELECT row_number() OVER (ORDER BY {key("o_orderkey")}, o_orderkey) - 1 AS row_id,
               o_orderkey, o_custkey, o_totalprice FROM orders"""
    step = f"((SELECT count(*) FROM n) - 1)::DOUBLE / {LINSPACE_SAMPLE - 1}"
    return {
        "best_answer": f"""WITH {ANSWERS}
            SELECT question_id, answer_id, answer_score, answer_html FROM best""",
        "best_line_per_order": """
            SELECT o_orderkey, o_custkey, o_totalprice, l_linenumber, l_quantity,
                   l_extendedprice
            FROM orders JOIN (
                SELECT * FROM lineitem QUALIFY row_number() OVER (
                    PARTITION BY l_orderkey
                    ORDER BY l_quantity DESC, l_linenumber, l_extendedprice) = 1)
            ON o_orderkey = l_orderkey""",
        "build_corpus": whole,
        "build_corpus_sampled": f"{whole} WHERE doc_id < {CORPUS_SAMPLE}",
        "corpus_csv_build": whole,
        "write_corpus": whole,
        "run_json": f"""WITH {CORPUS} SELECT count(*) AS objects,
            round(avg(length(title)), 2) AS title_chars_mean,
            round(avg(question_score), 3) AS question_score_mean FROM corpus""",
        "corpus_stats": f"""WITH {CORPUS} SELECT count(*) AS objects,
            round(avg(length(title)), 2) AS title_chars_mean,
            round(avg(length(question_body)), 2) AS body_chars_mean,
            round(avg(length(answer)), 2) AS answer_chars_mean,
            round(avg(question_score), 3) AS question_score_mean,
            round(avg(answer_score), 3) AS answer_score_mean FROM corpus""",
        "sample_key": f"SELECT c_custkey, {key('c_custkey')} AS sample_key FROM customer",
        "dense_row_id": numbered,
        "sample_queries": f"""SELECT doc_id, text FROM documents
            ORDER BY {key("doc_id")}, doc_id LIMIT {QUERY_SAMPLE}""",
        "sample_fit_rows": f"""SELECT vec_id, label FROM embeddings
            ORDER BY {key("vec_id", FIT_SEED)}, vec_id LIMIT {FIT_SAMPLE}""",
        "linspace_sample": f"""WITH n AS ({numbered}),
            picks AS (
                SELECT CASE WHEN j = {LINSPACE_SAMPLE - 1} THEN (SELECT count(*) FROM n) - 1
                            ELSE floor(j * ({step}))::BIGINT END AS row_id
                FROM (SELECT unnest(range({LINSPACE_SAMPLE})) AS j))
            SELECT row_id, o_orderkey, o_totalprice FROM n
            WHERE row_id IN (SELECT row_id FROM picks)""",
        "contiguous_ids": """SELECT count(*) AS n_rows, count(DISTINCT vec_id) AS n_distinct,
            min(vec_id) AS min_id, max(vec_id) AS max_id,
            (min(vec_id) = 0 AND max(vec_id) = count(*) - 1
             AND count(DISTINCT vec_id) = count(*)) AS contiguous FROM embeddings""",
        "csv_scan": """SELECT (conv_id * 1000 + turn)::VARCHAR AS "Id",
            conv_id::VARCHAR AS "ParentId", (length(text) % 7)::VARCHAR AS "Score",
            '<p>' || replace(text, chr(10), '</p>' || chr(10) || '<p>') || '</p>' AS "Body"
            FROM conversations WHERE role = 'assistant'""",
        "csv_split_scan": """SELECT (conv_id * 1000 + turn)::VARCHAR AS "Id",
            conv_id::VARCHAR AS "ParentId", (length(text) % 7)::VARCHAR AS "Score",
            '<p>' || replace(text, chr(10), '</p>' || chr(10) || '<p>') || '</p>' AS "Body"
            FROM conversations WHERE role = 'assistant'""",
    }


def _function_sql() -> dict[str, str]:
    return {
        "safe_cast": """
            SELECT event_id, raw,
                   coalesce(try_cast(trim(raw) AS INTEGER), 0)::BIGINT AS score
            FROM (SELECT event_id, CASE event_id % 6
                    WHEN 0 THEN whole WHEN 1 THEN ' ' || whole || '.6 '
                    WHEN 2 THEN whole || 'e2' WHEN 3 THEN '-' || whole || '.5'
                    WHEN 4 THEN 'x' || whole END AS raw
                  FROM (SELECT event_id, floor(value)::BIGINT::VARCHAR AS whole FROM events))""",
        "strip_html": f"SELECT page_id, {strip('html')} AS text FROM pages",
        "clean_text": f"SELECT page_id, {clean('html')} AS text FROM pages",
        "normalize_vectors": f"""WITH
            scaled AS (
                SELECT vec_id AS doc_id, list_transform(embedding, lambda x: x * 3::FLOAT) AS e
                FROM embeddings),
            unit AS (
                SELECT doc_id, list_transform(e, lambda x: x::DOUBLE / sqrt(list_inner_product(
                    e::DOUBLE[], e::DOUBLE[])))::FLOAT[] AS e FROM scaled)
            {entries("unit")}""",
        "validate_vectors": f"""SELECT count(*) AS n_vectors,
            sum((len(embedding) <> {VECTOR_DIM})::INTEGER)::BIGINT AS n_wrong_dimension,
            sum((len(list_filter(embedding, lambda x: NOT isfinite(x))) > 0)::INTEGER)::BIGINT
                AS n_not_finite,
            sum((abs(norm - 1) > 0.00101)::INTEGER)::BIGINT AS n_not_unit,
            round(avg(norm), 6) AS norm_mean, round(stddev_pop(norm), 6) AS norm_std
            FROM (SELECT embedding, sqrt(list_inner_product(
                embedding::DOUBLE[], embedding::DOUBLE[])) AS norm FROM embeddings)""",
        "encode_documents": f"""WITH d AS (SELECT doc_id AS id, text FROM documents),
            {encode("ev", "d")}, named AS (SELECT id AS doc_id, e FROM ev)
            {entries("named")}""",
        "encode_stream": f"""WITH d AS (SELECT doc_id AS id, text FROM documents),
            {encode("ev", "d")}, named AS (SELECT id AS doc_id, e FROM ev)
            {entries("named")}""",
        "encode_in_two_runs": f"""WITH d AS (SELECT doc_id AS id, text FROM documents),
            {encode("ev", "d")}, named AS (SELECT id AS doc_id, e FROM ev)
            {entries("named")}""",
        "encode_changed": f"""WITH d AS (SELECT doc_id AS id, text FROM documents),
            {encode("ev", "d")}, named AS (SELECT id AS doc_id, e FROM ev)
            {entries("named")}""",
        "encode_tfidf_documents": f"""WITH
            words AS (SELECT doc_id, unnest({words("text")}) AS w FROM documents),
            counts AS (
                SELECT doc_id, ('0x' || substr(md5(w), 1, 4))::INTEGER % {TFIDF_DIM} AS slot,
                       count(*) AS tf
                FROM words GROUP BY ALL),
            weights AS (
                SELECT slot, ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1)::DOUBLE)
                    AS idf
                FROM counts GROUP BY slot),
            every AS (
                SELECT d.doc_id, r.slot,
                       coalesce(c.tf * w.idf, 0) + CASE WHEN r.slot = 0 THEN 1 ELSE 0 END AS x
                FROM documents d CROSS JOIN (SELECT unnest(range({TFIDF_DIM})) AS slot) r
                LEFT JOIN counts c ON c.doc_id = d.doc_id AND c.slot = r.slot
                LEFT JOIN weights w ON w.slot = r.slot),
            unit AS (
                SELECT doc_id, slot, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS x
                FROM every)
            SELECT doc_id, slot AS dim, round(x::FLOAT::DOUBLE, 6) AS weight
            FROM unit WHERE x <> 0""",
        "incremental_pending": """SELECT doc_id, n_chars FROM documents
            WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
        "f32_matrix_scan": f"""WITH numbered AS (
                SELECT row_number() OVER (ORDER BY vec_id) - 1 AS doc_id, embedding AS e
                FROM embeddings)
            {entries("numbered")}""",
        "pca_report": f"""WITH parts AS (
                SELECT unnest(embedding)::DOUBLE AS x, unnest(range({VECTOR_DIM})) AS slot
                FROM embeddings)
            SELECT (SELECT count(*) FROM embeddings) AS n_vectors,
                   round(sum(v), 6) AS total_variance, round(sqrt(sum(m * m)), 6) AS mean_norm,
                   true AS orthonormal, true AS variance_as_told
            FROM (SELECT var_samp(x) AS v, avg(x) AS m FROM parts GROUP BY slot)""",
        "pca_stored": """SELECT vec_id AS doc_id, true AS unit_length, true AS as_fitted,
            true AS as_computed FROM embeddings""",
        "fold_project": f"""WITH {VECTORS}, {fold("f", "v", VECTOR_DIM, SMALL_VECTOR_DIM)},
            named AS (SELECT id AS doc_id, e FROM f) {entries("named")}""",
    }


LATENCY = """SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean,
    round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95
    FROM events GROUP BY event_type"""


def _evaluation_sql() -> dict[str, str]:
    systems = [
        ("exact_full", "hits", None, TEXT_DIM),
        ("exact_reduced", "small_hits", "hits", SMALL_TEXT_DIM),
    ] + [
        (f"cells_probe_{n}", f"hits_{n}", "small_hits", SMALL_TEXT_DIM)
        for n in COMPARED_PROBES
    ]
    lexical = ("lexical", "lexical_hits", "hits", "NULL::DOUBLE")
    probed = ", ".join(
        cell_topk(f"hits_{n}", "c", "sq", "sd", n, 10) for n in COMPARED_PROBES
    )
    *rows, lexical_row = [
        f"""SELECT '{name}' AS system, {QUALITY}, {
            f'''(SELECT round(avg(shared / 10.0::DOUBLE), 6) FROM (
                SELECT (SELECT count(*) FROM {base} a JOIN {hits} b USING (query_id, doc_id)
                        WHERE a.query_id = p.id) AS shared FROM page_queries p))'''
            if base else 'NULL::DOUBLE'
        } AS overlap_at_10,
        {
            f'''(SELECT bool_and(n >= 10) FROM (
                SELECT least((SELECT count(*) FROM {base} a WHERE a.query_id = p.id),
                             (SELECT count(*) FROM {hits} b WHERE b.query_id = p.id)) AS n
                FROM page_queries p))'''
            if base else 'NULL::BOOLEAN'
        } AS complete,
        round((SELECT count(*) FROM pages) * {dim} * 4 / (1024.0::DOUBLE * 1024.0), 2) AS size_mib
        FROM (SELECT p.id, coalesce((SELECT min(rank) FROM {hits} h
              WHERE h.query_id = p.id AND h.doc_id = p.id), 0) AS rank FROM page_queries p)"""
        for name, hits, base, dim in [*systems, lexical]
    ]
    compared = f"""WITH {PAGES}, {fold("sq", "pq", TEXT_DIM, SMALL_TEXT_DIM)},
        {fold("sd", "pd", TEXT_DIM, SMALL_TEXT_DIM)}, {topk("hits", "pq", "pd", 10)},
        {topk("small_hits", "sq", "sd", 10)}, {cells("c", "sd")},
        {query_cells("c", "sq")}, {probed}"""
    vector_rows = " UNION ALL ".join(rows)
    return {
        "known_item_ranks": f"""WITH {KNOWN_ITEM}
            SELECT query_id, query, relevant_doc_id, rank FROM ranks""",
        "known_item_per_query": f"""WITH {KNOWN_ITEM} SELECT query_id, rank,
            CASE WHEN rank BETWEEN 1 AND 10 THEN round(1.0::DOUBLE / rank, 6) ELSE 0 END
                AS reciprocal_rank_at_10,
            CASE WHEN rank BETWEEN 1 AND 10 THEN round(1.0::DOUBLE / log2(rank + 1), 6)
                ELSE 0 END AS ndcg_at_10,
            CASE WHEN rank = 1 THEN 1.0::DOUBLE ELSE 0 END AS recall_at_1,
            CASE WHEN rank BETWEEN 1 AND 5 THEN 1.0::DOUBLE ELSE 0 END AS recall_at_5,
            CASE WHEN rank BETWEEN 1 AND 10 THEN 1.0::DOUBLE ELSE 0 END AS recall_at_10
            FROM ranks""",
        "known_item_metrics": f"WITH {KNOWN_ITEM} SELECT {QUALITY} FROM ranks",
        "ann_overlap": f"""WITH {VECTORS}, {fold("f", "v", VECTOR_DIM, SMALL_VECTOR_DIM)},
            {topk("a", "v", "v", 10)}, {topk("b", "f", "f", 10)}
            SELECT count(*) AS queries, round(avg(shared / 10.0::DOUBLE), 6) AS overlap_at_10,
                   true AS complete
            FROM (SELECT v.id, (SELECT count(*) FROM a JOIN b USING (query_id, doc_id)
                                WHERE a.query_id = v.id) AS shared FROM v)""",
        "compare_retrievers": f"{compared} {vector_rows}",
        "compare_with_lexical": f"{compared}, {LEXICAL} {vector_rows} UNION ALL {lexical_row}",
        "lexical_topk": f"""WITH {PAGES}, {LEXICAL}
            SELECT query_id, rank, doc_id, round(score, 6) AS score FROM lexical_hits""",
        "known_item_lexical": f"""WITH {PAGES}, {LEXICAL} SELECT {QUALITY} FROM (
            SELECT p.id, coalesce((SELECT min(rank) FROM lexical_hits h
                WHERE h.query_id = p.id AND h.doc_id = p.id), 0) AS rank FROM page_queries p)""",
        "metrics_csv": LATENCY,
        "stage_latency": """SELECT stage, count(ms) AS n, round(avg(ms), 3) AS mean,
            round(quantile_cont(ms, 0.5), 3) AS p50, round(quantile_cont(ms, 0.95), 3) AS p95
            FROM (SELECT 'retrieval_ms' AS stage, value AS ms FROM events
                  UNION ALL SELECT 'generation_ms', value * 3 + 1 FROM events)
            GROUP BY stage""",
        "latency_summary": LATENCY,
        "threshold_metrics": f"""WITH {LABELLED},
            counts AS (
                SELECT sum((p AND y)::INTEGER)::DOUBLE AS tp,
                       sum((p AND NOT y)::INTEGER)::DOUBLE AS fp,
                       sum((NOT p AND y)::INTEGER)::DOUBLE AS fn,
                       sum((NOT p AND NOT y)::INTEGER)::DOUBLE AS tn
                FROM (SELECT n_chars >= {LABEL_THRESHOLD} AS p, quality = 1 AS y FROM labelled)),
            rated AS (
                SELECT *, (tp + tn) / (tp + fp + fn + tn) AS accuracy, {RATES} FROM counts)
            SELECT {LABEL_THRESHOLD}::DOUBLE AS threshold, tp::BIGINT AS tp, fp::BIGINT AS fp,
                   fn::BIGINT AS fn, tn::BIGINT AS tn, accuracy, precision, recall,
                   CASE WHEN precision + recall > 0
                        THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1
            FROM rated""",
        "calibrate_threshold": f"""WITH {THRESHOLDS} SELECT * FROM curve
            ORDER BY f1 DESC, accuracy DESC, threshold LIMIT 1""",
        "all_thresholds": f"WITH {THRESHOLDS} SELECT * FROM curve",
    }


def _answer_sql() -> dict[str, str]:
    system = SYSTEM_PROMPT.replace("'", "''")
    # A stand-in for a model: it tells the length of its prompt and cites [1], or [9] at times.
    generated = AUDIT.replace(
        "drafted AS (",
        """prompts AS (
        SELECT query_id, 'Question:' || chr(10) || query || chr(10) || chr(10) || 'Sources:'
               || chr(10) || context || chr(10) || chr(10) || 'Write the answer.' AS prompt
        FROM questions JOIN contexts USING (query_id)),
    prompted AS (
        SELECT query_id, length(prompt) AS prompt_tokens,
               'A prompt of ' || length(prompt) || ' characters. ['
               || CASE WHEN length(prompt) % 3 = 0 THEN '9' ELSE '1' END || ']' AS draft
        FROM prompts),
    drafted AS (""",
        1,
    ).replace("JOIN drafts d", "JOIN prompted d")
    return {
        "fetch_ranked_documents": f"""WITH {CANDIDATES} SELECT query_id, rank, doc_id,
            vector_similarity, title, question_body, answer, url
            FROM candidates""",
        "fetch_from_ranges": f"""WITH {CANDIDATES} SELECT query_id, rank, doc_id,
            vector_similarity, title, question_body, answer, url
            FROM candidates""",
        "score_candidate_pairs": f"""WITH {CANDIDATES} SELECT query_id, doc_id,
            round(reranker_score, 6) AS reranker_score FROM scored""",
        "retrieve_rerank": f"""WITH {SOURCED} SELECT query_id, source_rank, doc_id,
            vector_similarity,
            round(reranker_score, 6) AS reranker_score,
            round(final_score, 6) AS final_score, title FROM reranked""",
        "rerank_candidates": f"""WITH {SOURCED} SELECT query_id, source_rank, doc_id,
            round(final_score, 6) AS final_score FROM reranked""",
        "build_context": f"WITH {SOURCED} SELECT query_id, context FROM contexts",
        "build_prompt": f"""WITH {SOURCED} SELECT query_id, '{system}' AS system_prompt,
            'Question:' || chr(10) || query || chr(10) || chr(10) || 'Sources:' || chr(10)
            || context || chr(10) || chr(10) || 'Write the answer.' AS user_prompt
            FROM questions JOIN contexts USING (query_id)""",
        "answer_gate": f"""WITH {SOURCED} SELECT query_id,
            round(reranker_score, 6) AS top_reranker_score,
            reranker_score < 0.449093 AS abstained FROM first_source""",
        "extractive_answer": f"""WITH {SOURCED}
            SELECT query_id, {extract("answer")} AS answer FROM first_source""",
        "citation_metrics": f"""WITH cited AS (
                SELECT conv_id, turn, replace(text, chr(10),
                    ' [' || (turn % 5)::VARCHAR || ']' || chr(10))
                    || ' [' || (turn % 5)::VARCHAR || ']' AS answer
                FROM conversations WHERE role = 'assistant'),
            {measured("m", "cited", "answer", "3")}
            SELECT conv_id, turn, round(coverage, 6) AS citation_coverage,
                   round(validity, 6) AS citation_validity FROM m""",
        "audit_answers": f"""WITH {AUDIT} SELECT query_id, answer, used_fallback,
            round(citation_coverage, 6) AS citation_coverage,
            round(citation_validity, 6) AS citation_validity FROM audited""",
        "answer_questions": f"""WITH {AUDIT} SELECT query_id, query, answer, abstained,
            round(top_score, 6) AS top_reranker_score, used_fallback,
            round(citation_coverage, 6) AS citation_coverage,
            round(citation_validity, 6) AS citation_validity, source_ids FROM records""",
        "answer_generated": f"""WITH {generated} SELECT query_id, query, answer, abstained,
            used_fallback, CASE WHEN NOT abstained THEN prompt_tokens END AS prompt_tokens,
            CASE WHEN NOT abstained THEN 5::BIGINT END AS output_tokens, source_ids
            FROM records JOIN prompted USING (query_id)""",
        "answer_resumed": f"""WITH {generated} SELECT query_id, query, answer, abstained,
            used_fallback, CASE WHEN NOT abstained THEN prompt_tokens END AS prompt_tokens,
            CASE WHEN NOT abstained THEN 5::BIGINT END AS output_tokens, source_ids
            FROM records JOIN prompted USING (query_id)""",
        "answer_summary": f"""WITH {AUDIT} SELECT count(*) AS queries,
            round(avg((in_domain <> abstained)::INTEGER), 6) AS behaviour_accuracy,
            round(avg((NOT abstained)::INTEGER) FILTER (in_domain), 6) AS in_domain_answer_rate,
            round(avg(abstained::INTEGER) FILTER (NOT in_domain), 6)
                AS out_of_domain_abstention_rate,
            round(avg(citation_coverage), 6) AS citation_coverage,
            round(avg(citation_validity), 6) AS citation_validity,
            round(avg(used_fallback::INTEGER) FILTER (NOT abstained), 6) AS fallback_rate
            FROM records""",
    }


def all_sql() -> dict[str, str]:
    return {**_search_sql(), **_corpus_sql(), **_function_sql(), **_evaluation_sql(), **_answer_sql()}
