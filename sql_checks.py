"""The same results in DuckDB SQL, written from the formulas and not from the Spark code.

Queries share common table expressions; each list of parts below is put together into one statement.
Scores are rounded to six places before ranking, as in the engine.
"""

from __future__ import annotations

from stand_ins import REPORT, REPORT_COLUMN, STOP_WORDS

# White space as Python's str.split() sees it.
WS = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
)
WORD = r"[\p{L}\p{N}_]{2,}"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}|{WS}$', '', 'g')"


def spaced(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{WS}'), lambda t: t <> '')"


DOCUMENTS = """
docs AS MATERIALIZED (
  SELECT *, concat_ws(' ', koumoku_name_full, bunya_name, chuubunrui_name, shoubunrui_name, definition, stat_name)
           AS search_text
  FROM (SELECT d.doc_id, CAST(d.doc_id AS VARCHAR) AS koumoku_code, coalesce(text, '') AS koumoku_name,
               coalesce(text, '') AS koumoku_name_full, lang AS bunya_name, source AS chuubunrui_name,
               '' AS shoubunrui_name, '' AS stat_name,
               coalesce('quality ' || quality || ' toxic ' || toxic, '') AS definition
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id))"""

PARTS = """
docs AS MATERIALIZED (
  SELECT *, concat_ws(' ', koumoku_name_full, bunya_name, chuubunrui_name, shoubunrui_name, definition, stat_name)
           AS search_text
  FROM (SELECT p_partkey AS doc_id, CAST(p_partkey AS VARCHAR) AS koumoku_code, p_name AS koumoku_name,
               p_name AS koumoku_name_full, p_brand AS bunya_name, p_type AS chuubunrui_name,
               CAST(p_size AS VARCHAR) AS shoubunrui_name, '' AS stat_name, coalesce(s_name, '') AS definition
        FROM part LEFT JOIN supplier ON p_partkey = s_suppkey))"""


def queries_from(select: str) -> str:
    return f"""
queries AS MATERIALIZED (
  SELECT query_id, {strip("query")} AS query FROM ({select}) WHERE {strip("query")} <> '')"""


PASSAGES = queries_from("SELECT item_id AS query_id, text AS query FROM benchmark")
SUPPLIERS = queries_from("SELECT s_suppkey AS query_id, s_name AS query FROM supplier")
CONVERSATIONS = queries_from("SELECT conv_id * 1000000 + turn AS query_id, text AS query FROM conversations")
PART_NAMES = queries_from(
    """SELECT min(p_partkey) AS query_id, p_name || ' ' || p_type || ' ' || p_brand AS query
       FROM part GROUP BY p_name, p_type, p_brand"""
)

BM25_INDEX = f"""
post AS MATERIALIZED (
  SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({spaced("search_text")}) AS term FROM docs)
  GROUP BY doc_id, term),
dl AS (SELECT d.doc_id, coalesce(sum(p.tf), 0) AS dl FROM docs d LEFT JOIN post p USING (doc_id) GROUP BY d.doc_id),
size AS (SELECT count(*) AS n, sum(dl) / count(*) AS avgdl FROM dl),
term_df AS MATERIALIZED (SELECT term, count(*) AS df, sum(tf) AS cf FROM post GROUP BY term),
term_raw AS MATERIALIZED (
  SELECT term, df, cf, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS raw FROM term_df, size),
term_mean AS MATERIALIZED (SELECT avg(raw) AS mean_raw FROM term_raw),
term_idf AS (
  SELECT term, df, cf, CASE WHEN raw >= 0 THEN raw ELSE 0.25::DOUBLE * mean_raw END AS idf FROM term_raw, term_mean)"""

# The same statistics straight from the texts, nothing but the terms kept.
TERM_STATS = f"""
term_df AS (
  SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf
  FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({spaced("search_text")}) AS term FROM docs)
        GROUP BY doc_id, term)
  GROUP BY term),
term_log AS (
  SELECT term, df, cf, ln((SELECT count(*) FROM docs) - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS raw FROM term_df),
term_raw AS (SELECT term, df, cf, raw, avg(raw) OVER () AS mean_raw FROM term_log)"""

BM25 = f"""
q_space AS (
  SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({spaced("query")}) AS term FROM queries)
  GROUP BY query_id, term),
bm_score AS MATERIALIZED (
  SELECT query_id, p.doc_id,
         round(sum(qtf * idf * tf * 2.5::DOUBLE
                   / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score
  FROM q_space q JOIN post p USING (term) JOIN term_idf USING (term) JOIN dl ON dl.doc_id = p.doc_id, size
  GROUP BY query_id, p.doc_id)"""


def ranked(scores: str, name: str, depth: int) -> str:
    """Every document ranked for every query, unmatched ones with 0, cut to a list."""
    return f"""
{name} AS MATERIALIZED (
  SELECT query_id, doc_id, score, rk FROM (
    SELECT query_id, doc_id, score,
           CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rk
    FROM (SELECT q.query_id, d.doc_id, coalesce(s.score, 0.0::DOUBLE) AS score
          FROM queries q CROSS JOIN docs d
          LEFT JOIN {scores} s ON s.query_id = q.query_id AND s.doc_id = d.doc_id))
  WHERE rk <= {depth})"""


def matched(scores: str, name: str, depth: int) -> str:
    return f"""
{name} AS (
  SELECT query_id, doc_id, score, rk FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rk
    FROM {scores} WHERE score > 0)
  WHERE rk <= {depth})"""


def grams(table: str, key: str, text: str, name: str, stop_words: tuple[str, ...] = ()) -> str:
    words = f"regexp_extract_all(lower({text}), '{WORD}')"
    if stop_words:
        listed = ", ".join(f"'{w}'" for w in stop_words)
        words = f"list_filter({words}, lambda w: w NOT IN ({listed}))"
    return f"""
{name}_words AS MATERIALIZED (
  SELECT {key}, unnest(l) AS term, generate_subscripts(l, 1) AS pos
  FROM (SELECT {key}, {words} AS l FROM {table})),
{name} AS MATERIALIZED (
  SELECT {key}, term, count(*) AS tf FROM (
    SELECT {key}, term FROM {name}_words
    UNION ALL
    SELECT {key}, term || ' ' || following FROM (
      SELECT {key}, term, lead(term) OVER (PARTITION BY {key} ORDER BY pos) AS following FROM {name}_words)
    WHERE following IS NOT NULL)
  GROUP BY {key}, term)"""


def unit_rows(counted: str, key: str, name: str) -> str:
    return f"""
{name} AS MATERIALIZED (
  SELECT {key}, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY {key})) AS w
  FROM (SELECT {key}, term, tf * idf AS raw FROM {counted} JOIN vocab USING (term)))"""


def tfidf_index(stop_words: tuple[str, ...] = ()) -> str:
    return (
        grams("docs", "doc_id", "search_text", "gram", stop_words)
        + """,
vocab AS MATERIALIZED (
  SELECT term, df, cf, ln((1 + (SELECT count(*) FROM docs)) / (1 + df)::DOUBLE) + 1 AS idf
  FROM (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM gram GROUP BY term)
  ORDER BY cf DESC, term LIMIT 10000),"""
        + unit_rows("gram", "doc_id", "weight")
    )


def tfidf_scores(stop_words: tuple[str, ...] = ()) -> str:
    return (
        grams("queries", "query_id", "query", "q_gram", stop_words)
        + ","
        + unit_rows("q_gram", "query_id", "q_weight")
        + """,
tf_score AS MATERIALIZED (
  SELECT query_id, doc_id, round(sum(a.w * b.w), 6) AS score
  FROM q_weight a JOIN weight b USING (term) GROUP BY query_id, doc_id)"""
    )


TFIDF_INDEX, TFIDF = tfidf_index(), tfidf_scores()


def hashed(table: str, key: str, text: str, name: str) -> str:
    """Token counts in 64 md5 buckets, unit length, as single precision."""
    stripped = strip(f"coalesce({text}, '')")
    clean = f"CASE WHEN {stripped} = '' THEN '統計指標' ELSE {stripped} END"
    return f"""
{name} AS MATERIALIZED (
  SELECT {key}, b, CAST(CAST(c / sqrt(sum(c * c) OVER (PARTITION BY {key})) AS FLOAT) AS DOUBLE) AS v
  FROM (SELECT {key}, ('0x' || substr(md5(t), 1, 8))::BIGINT % 64 AS b, CAST(count(*) AS DOUBLE) AS c
        FROM (SELECT {key}, unnest({spaced(clean)}) AS t FROM {table}) GROUP BY 1, 2))"""


HASHED = (
    hashed("docs", "doc_id", "search_text", "hash_once")
    + """,
hash_doc AS MATERIALIZED (
  SELECT doc_id, b, CAST(CAST(v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)) AS FLOAT) AS DOUBLE) AS v FROM hash_once),"""
    + hashed("queries", "query_id", "query", "hash_query")
    + """,
vec_score AS MATERIALIZED (
  SELECT query_id, doc_id, round(sum(a.v * b.v), 6) AS score
  FROM hash_query a JOIN hash_doc b USING (b) GROUP BY query_id, doc_id)"""
)


def fused(depth: int, weight: float, name: str = "fused") -> str:
    rest = (1 - weight) / 2

    def scaled(source: str, place: int) -> str:
        return f"""
    SELECT query_id, doc_id, {place} AS src, rk,
           CASE WHEN top > 0 THEN score / top ELSE 0 END * {rest}::DOUBLE AS part
    FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS top FROM {source})"""

    return f"""
{name} AS MATERIALIZED (
  SELECT query_id, doc_id, score, rk FROM (
    SELECT query_id, doc_id, score,
           CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen) AS INTEGER) AS rk
    FROM (SELECT query_id, doc_id, round(sum(part), 6) AS score, min(src * 1000000000 + rk) AS seen
          FROM (SELECT query_id, doc_id, 0 AS src, rk, score * {weight}::DOUBLE AS part FROM vec_list
    UNION ALL {scaled("bm_list", 1)}
    UNION ALL {scaled("tf_list", 2)})
          GROUP BY query_id, doc_id))
  WHERE rk <= {depth})"""


FIELDS = ["koumoku_name_full", "bunya_name", "chuubunrui_name", "shoubunrui_name", "definition", "stat_name"]


def reranked(source: str, k: int) -> str:
    def field(f: str) -> str:
        return (
            f"coalesce(CASE WHEN contains(lower({f}), lower(query)) THEN 2 ELSE 0 END"
            f" + len(list_intersect(list_distinct({spaced('lower(query)')}), list_distinct({spaced(f'lower({f})')}))), 0)"
        )

    total = " + ".join(field(f) for f in FIELDS)
    return f"""
lexical AS MATERIALIZED (
  SELECT s.query_id, s.doc_id, s.score, s.rk, CAST({total} AS INTEGER) AS rerank_score
  FROM {source} s JOIN queries q ON q.query_id = s.query_id JOIN docs d ON d.doc_id = s.doc_id),
results AS MATERIALIZED (
  SELECT * FROM (
    SELECT query_id, doc_id, score, rerank_score,
           CAST(row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rk) AS INTEGER) AS rank
    FROM lexical)
  WHERE rank <= {k})"""


RESULT = """SELECT query_id, rank, doc_id, koumoku_name, koumoku_name_full, bunya_name, chuubunrui_name, shoubunrui_name,
       score, rerank_score FROM results JOIN docs USING (doc_id)"""


def lists(depth: int) -> list[str]:
    return [
        BM25_INDEX,
        BM25,
        TFIDF_INDEX,
        TFIDF,
        HASHED,
        ranked("bm_score", "bm_list", depth),
        ranked("tf_score", "tf_list", depth),
        ranked("vec_score", "vec_list", depth),
    ]


def statement(parts: list[str], select: str) -> str:
    return "WITH " + ",".join(parts) + "\n" + select


def hybrid(corpus: str, queries: str, k: int, weight: float, select: str = RESULT, more: tuple[str, ...] = ()) -> str:
    return statement([corpus, queries, *lists(2 * k), fused(2 * k, weight), reranked("fused", k), *more], select)


FACETS = """
hits AS (
  SELECT query_id, rank, bunya_name AS facet, koumoku_name_full AS name FROM results JOIN docs USING (doc_id)),
groups AS (
  SELECT query_id, facet, dense_rank() OVER (PARTITION BY query_id ORDER BY first) AS facet_pos
  FROM (SELECT query_id, facet, min(rank) AS first FROM hits GROUP BY query_id, facet)),
others AS (
  SELECT * FROM (
    SELECT g.query_id, g.facet, d.koumoku_name_full AS name,
           row_number() OVER (PARTITION BY g.query_id, g.facet ORDER BY d.doc_id) AS place
    FROM groups g JOIN docs d ON d.bunya_name = g.facet
    WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.query_id = g.query_id AND h.facet = g.facet
                      AND h.name = d.koumoku_name_full))
  WHERE place <= 10),
items AS MATERIALIZED (
  SELECT query_id, facet, CAST(facet_pos AS INTEGER) AS facet_pos, name, is_hit,
         CAST(row_number() OVER (PARTITION BY query_id, facet ORDER BY is_hit DESC, place) AS INTEGER) AS item_pos
  FROM (SELECT query_id, facet, name, true AS is_hit, rank AS place FROM hits
        UNION ALL SELECT query_id, facet, name, false, place FROM others)
  JOIN groups USING (query_id, facet)),
lines AS MATERIALIZED (
  SELECT query_id, facet_pos, facet, CAST(count(*) AS INTEGER) AS n_names,
         '【' || facet || '】(' || count(*) || '件利用可能): '
         || string_agg(name, ', ' ORDER BY item_pos) FILTER (WHERE item_pos <= 15) AS line
  FROM items GROUP BY query_id, facet_pos, facet)"""

# What the stand-in responder answers, as rows: up to three names per field, then one unknown name.
ANSWERS = """
answered AS (
  SELECT query_id, facet_pos AS perspective_pos, facet AS title, '' AS description, item_pos AS indicator_pos,
         CASE item_pos WHEN 1 THEN name WHEN 2 THEN ' ' || upper(name) || '　' ELSE name || '?' END AS name,
         CASE item_pos WHEN 1 THEN 'first of ' || facet WHEN 2 THEN '理由なし' ELSE 'unknown' END AS reason
  FROM items WHERE item_pos <= 3
  UNION ALL
  SELECT query_id, CAST(max(facet_pos) + 1 AS INTEGER), '無題の観点', '', 1, 'no such name', '理由なし'
  FROM items GROUP BY query_id)"""


def found(names: str, name: str) -> str:
    """First row of equal name, else the first whose name contains it in any case."""
    key = strip("name")
    row = strip("d.koumoku_name_full")
    return f"""
asked AS MATERIALIZED (SELECT DISTINCT name, {key} AS key FROM {names} WHERE name IS NOT NULL),
by_name AS MATERIALIZED (
  SELECT key, min(doc_id) AS doc_id FROM (SELECT DISTINCT key FROM asked WHERE key <> '')
  JOIN docs d ON {row} = key GROUP BY key),
by_part AS MATERIALIZED (
  SELECT key, min(doc_id) AS doc_id
  FROM (SELECT DISTINCT key FROM asked WHERE key <> '' AND key NOT IN (SELECT key FROM by_name))
  JOIN docs d ON contains(lower(d.koumoku_name_full), lower(key)) GROUP BY key),
{name} AS MATERIALIZED (
  SELECT name, a.key, CASE WHEN n.doc_id IS NOT NULL THEN 'exact' WHEN p.doc_id IS NOT NULL THEN 'contains' END AS matched,
         coalesce(n.doc_id, p.doc_id) AS doc_id
  FROM asked a LEFT JOIN by_name n ON n.key = a.key LEFT JOIN by_part p ON p.key = a.key)"""


VERIFIED = (
    found("answered", "hit")
    + """,
checked AS (
  SELECT a.*, h.matched, h.doc_id, d.koumoku_name_full, d.bunya_name, d.chuubunrui_name, d.shoubunrui_name, d.koumoku_code,
         count(*) OVER (PARTITION BY query_id, perspective_pos) AS n_verified
  FROM answered a JOIN hit h ON h.name = a.name JOIN docs d ON d.doc_id = h.doc_id)"""
)

LOOKUP_NAMES = """
wanted AS (
  SELECT unnest(['　' || p_name || ' ', upper(split_part(p_name, ' ', -1)), p_name || '?']) AS name FROM part)"""

TRIALS = """
trials AS (
  SELECT event_type AS query, 'model-' || (user_id % 3) AS model,
         CASE WHEN event_type <> 'error' THEN value END AS seconds,
         CASE WHEN event_type <> 'error' THEN CAST(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS INTEGER) ELSE 0 END AS n
  FROM events),
per_query AS (
  SELECT query, model, avg(seconds) AS avg_seconds, avg(n) AS avg_indicators,
         100.0::DOUBLE * count(seconds) / count(*) AS success_pct
  FROM trials GROUP BY query, model),
per_model AS (
  SELECT model, round(avg(avg_seconds), 6) AS avg_seconds, round(avg(avg_indicators), 6) AS avg_indicators,
         round(100.0::DOUBLE * count(*) / (SELECT count(DISTINCT query) FROM trials), 6) AS success_pct
  FROM per_query WHERE avg_seconds IS NOT NULL AND avg_seconds <> 0 GROUP BY model)"""


def stored_vectors(select: str) -> str:
    return f"""WITH score AS (
  SELECT item_id AS query_id, e.vec_id AS doc_id,
         round(list_inner_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score
  FROM benchmark JOIN embeddings q ON q.vec_id = item_id CROSS JOIN embeddings e)
SELECT query_id, doc_id, score, rk FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rk FROM score)
WHERE {select}"""


FACET_HYBRID = dict(corpus=PARTS, queries=PART_NAMES, k=40, weight=0.6)
CORPUS_ROWS = """SELECT doc_id, koumoku_code, koumoku_name, koumoku_name_full, bunya_name, chuubunrui_name,
       shoubunrui_name, stat_name, definition, search_text FROM docs"""
JSON_BLOCK = r"nullif(regexp_extract(text, '(?s)\{.*\}'), '')"


def all_checks() -> dict[str, str]:
    bm = [BM25_INDEX, BM25]
    tf = [TFIDF_INDEX, TFIDF]
    items = (FACETS,)
    answers = (FACETS, ANSWERS)
    checked = (FACETS, ANSWERS, VERIFIED)
    link = f"'{REPORT}&filter={REPORT_COLUMN} eq ''' || koumoku_code || ''''"
    stripped = strip("coalesce(text, '')")
    return {
        "bm25_topk": statement([DOCUMENTS, PASSAGES, *bm, matched("bm_score", "l", 10)], "SELECT * FROM l"),
        "bm25_topk_padded": statement([PARTS, SUPPLIERS, *bm, ranked("bm_score", "l", 80)], "SELECT * FROM l"),
        "bm25_conversations": statement([DOCUMENTS, CONVERSATIONS, *bm, matched("bm_score", "l", 10)], "SELECT * FROM l"),
        "bm25_term_stats": statement(
            [DOCUMENTS.replace(" MATERIALIZED", ""), TERM_STATS],
            "SELECT term, df, cf, round(CASE WHEN raw >= 0 THEN raw ELSE 0.25::DOUBLE * mean_raw END, 6) AS idf FROM term_raw",
        ),
        "bm25_term_spectrum": statement(
            [DOCUMENTS.replace(" MATERIALIZED", ""), TERM_STATS],
            """SELECT df, cf, round(CASE WHEN raw >= 0 THEN raw ELSE 0.25::DOUBLE * mean_raw END, 6) AS idf, count(*) AS n_terms,
       min(term) AS first_term, max(term) AS last_term, CAST(sum(length(term)) AS BIGINT) AS n_chars
FROM term_raw GROUP BY df, cf, raw, mean_raw""",
        ),
        "tfidf_topk": statement([DOCUMENTS, PASSAGES, *tf, matched("tf_score", "l", 10)], "SELECT * FROM l"),
        "tfidf_topk_padded": statement([PARTS, SUPPLIERS, *tf, ranked("tf_score", "l", 80)], "SELECT * FROM l"),
        "tfidf_stop_words": statement(
            [PARTS, PART_NAMES, tfidf_index(tuple(STOP_WORDS)), tfidf_scores(tuple(STOP_WORDS)), ranked("tf_score", "l", 40)],
            "SELECT * FROM l",
        ),
        "tfidf_vocabulary": statement(
            [DOCUMENTS, TFIDF_INDEX], "SELECT term, df, cf, round(idf, 6) AS idf FROM vocab"
        ),
        "tfidf_weights": statement([DOCUMENTS, TFIDF_INDEX], "SELECT doc_id, term, round(w, 6) AS w FROM weight"),
        "vector_topk": stored_vectors("rk <= 20"),
        "vector_topk_blocks": stored_vectors("rk <= 20"),
        "l2_normalise": """
SELECT vec_id, CAST(pos - 1 AS INTEGER) AS pos,
       round(CASE WHEN norm > 0 THEN CAST(CAST(x / norm AS FLOAT) AS DOUBLE) ELSE x END, 6) AS value
FROM (SELECT vec_id, pos, x, sqrt(sum(x * x) OVER (PARTITION BY vec_id)) AS norm
      FROM (SELECT vec_id, generate_subscripts(embedding, 1) AS pos,
                   CAST(CAST(unnest(embedding)::DOUBLE * label AS FLOAT) AS DOUBLE) AS x FROM embeddings))""",
        "vector_dimension": """
SELECT count(*) AS n_vectors, CAST(max(len(embedding)) AS INTEGER) AS dimension,
       min(len(embedding)) = max(len(embedding)) AS uniform FROM embeddings WHERE embedding IS NOT NULL""",
        "hash_embed": statement(
            [hashed("documents", "doc_id", "text", "h")],
            "SELECT doc_id, CAST(b AS INTEGER) AS pos, round(v, 6) AS value FROM h",
        ),
        "fusion_only": statement([DOCUMENTS, PASSAGES, *lists(80), fused(80, 0.6)], "SELECT * FROM fused"),
        "rerank": statement(
            [DOCUMENTS, PASSAGES, *bm, matched("bm_score", "l", 80), reranked("l", 40)],
            "SELECT query_id, rank, doc_id, score, rerank_score FROM results",
        ),
        "hybrid_search": hybrid(DOCUMENTS, PASSAGES, 40, 0.6),
        "hybrid_search_keywords": hybrid(DOCUMENTS, PASSAGES, 50, 0.0),
        "hybrid_search_vectors": hybrid(DOCUMENTS, PASSAGES, 50, 1.0),
        "hybrid_search_fused_order": statement(
            [DOCUMENTS, PASSAGES, *lists(40), fused(40, 0.6)],
            """SELECT query_id, rk AS rank, doc_id, koumoku_name, koumoku_name_full, bunya_name, chuubunrui_name,
       shoubunrui_name, score FROM fused JOIN docs USING (doc_id) WHERE rk <= 20""",
        ),
        "hybrid_search_parts": hybrid(**FACET_HYBRID),
        "facet_distribution": hybrid(
            **FACET_HYBRID,
            select="SELECT query_id, facet, count(*) AS n_results FROM hits GROUP BY query_id, facet",
            more=items,
        ),
        "facet_expand": hybrid(
            **FACET_HYBRID, select="SELECT query_id, facet, facet_pos, item_pos, name, is_hit FROM items", more=items
        ),
        "facet_summary": hybrid(
            **FACET_HYBRID, select="SELECT query_id, facet_pos, facet, n_names, line FROM lines", more=items
        ),
        "facet_details": hybrid(
            **FACET_HYBRID,
            select="""SELECT query_id, name || ' (' || facet || ')' AS label,
       CAST(row_number() OVER (PARTITION BY query_id ORDER BY facet_pos, item_pos) AS INTEGER) AS detail_pos
FROM items WHERE item_pos <= 12""",
            more=items,
        ),
        "facet_totals": hybrid(
            **FACET_HYBRID,
            select="SELECT query_id, count(DISTINCT facet) AS n_facets, count(*) AS n_names FROM items GROUP BY query_id",
            more=items,
        ),
        "prompt_text": hybrid(
            **FACET_HYBRID,
            select="SELECT query_id, string_agg(line, chr(10) ORDER BY facet_pos) AS available FROM lines GROUP BY query_id",
            more=items,
        ),
        "answers_flatten": hybrid(**FACET_HYBRID, select="SELECT * FROM answered", more=answers),
        "answers_count": hybrid(
            **FACET_HYBRID,
            select="SELECT query_id, true AS is_valid, CAST(count(*) AS INTEGER) AS n_indicators FROM answered GROUP BY query_id",
            more=answers,
        ),
        "answers_verified": hybrid(
            **FACET_HYBRID,
            select="""SELECT query_id, perspective_pos, title, description, indicator_pos, name, reason, matched, doc_id,
       koumoku_name_full, bunya_name, chuubunrui_name, shoubunrui_name, koumoku_code, n_verified FROM checked""",
            more=checked,
        ),
        "answer_cards": hybrid(
            **FACET_HYBRID,
            select=f"""SELECT query_id, perspective_pos, title, description, n_verified, indicator_pos,
       koumoku_name_full AS found_name, koumoku_code AS code, reason,
       bunya_name || ' > ' || chuubunrui_name || ' > ' || shoubunrui_name AS path, {link} AS link FROM checked""",
            more=checked,
        ),
        "lookup_names": statement(
            [PARTS, LOOKUP_NAMES, found("wanted", "hit")], "SELECT name, key, matched, coalesce(doc_id, -1) AS doc_id FROM hit"
        ),
        "lookup_exact": statement(
            [PARTS, LOOKUP_NAMES, found("wanted", "hit")], "SELECT key, doc_id FROM by_name"
        ),
        "lookup_fallback": statement(
            [DOCUMENTS, "wanted AS (SELECT text AS name FROM benchmark)", found("wanted", "hit")],
            "SELECT name, matched, doc_id, koumoku_name_full, bunya_name, chuubunrui_name, shoubunrui_name, koumoku_code"
            " FROM hit JOIN docs USING (doc_id)",
        ),
        "lookup_fallback_regex": statement(
            [PARTS, "wanted AS (SELECT DISTINCT substr(p_name, 1, 2) || '.*' || split_part(p_name, ' ', -1) AS key FROM part)"],
            """SELECT key, min(doc_id) AS doc_id FROM wanted JOIN docs ON regexp_matches(koumoku_name_full, key, 'i') GROUP BY key""",
        ),
        "catalogue_labels": statement(
            [PARTS],
            f"""SELECT doc_id, bunya_name || ' > ' || chuubunrui_name || ' > ' || shoubunrui_name AS path,
       koumoku_name_full || ' (' || bunya_name || ')' AS label, {link} AS link FROM docs""",
        ),
        "corpus_build": statement([DOCUMENTS], CORPUS_ROWS),
        "corpus_from_csv": statement([PARTS], CORPUS_ROWS.replace("doc_id, ", "", 1)),
        "corpus_csv_numbers": """
SELECT row_number() OVER (ORDER BY p_partkey, again) - 1 AS doc_id, CAST(p_partkey AS VARCHAR) AS koumoku_code,
       coalesce(CASE again WHEN 0 THEN s_name ELSE 'again ' || s_name END, '') AS definition
FROM part LEFT JOIN (SELECT s_suppkey, s_name, unnest([0, 1]) AS again FROM supplier) ON p_partkey = s_suppkey""",
        "clean_text_stats": f"""
SELECT count(*) AS n_texts, count(*) FILTER (WHERE text IS NULL) AS n_null,
       count(*) FILTER (WHERE {stripped} = '') AS n_blank,
       count(*) FILTER (WHERE {stripped} IN ('', '統計指標')) AS n_default,
       CAST(sum(length(CASE WHEN {stripped} = '' THEN '統計指標' ELSE {stripped} END)) AS BIGINT) AS n_clean_chars
FROM (SELECT text FROM documents UNION ALL SELECT text FROM conversations UNION ALL SELECT html FROM pages)""",
        "row_counts": "SELECT 'catalogue' AS \"table\", count(*) AS n_rows FROM part "
        "UNION ALL SELECT 'definitions', count(*) FROM supplier",
        "index_stats": statement(
            [DOCUMENTS, BM25_INDEX],
            """SELECT n AS total_records, 'hashing-64' AS embedding_model, 64 AS vector_dimension, n AS n_vectors,
       (SELECT CAST(sum(dl) AS BIGINT) FROM dl) AS n_tokens, round(avgdl, 6) AS avg_length,
       (SELECT round(avg(raw), 6) FROM term_raw) AS avg_raw, (SELECT count(*) FROM term_raw) AS n_terms FROM size""",
        ),
        "index_rebuild": " UNION ALL ".join(
            "SELECT * FROM ("
            + statement(
                [PARTS.replace("coalesce(s_name, '')", definition), BM25_INDEX],
                f"SELECT '{reader}' AS reader, (SELECT count(*) FROM docs) AS n_docs, count(*) AS n_postings,"
                " CAST(sum(tf) AS BIGINT) AS n_tokens FROM post",
            )
            + ")"
            for reader, definition in (("old", "''"), ("new", "coalesce(s_name, '')"), ("opened", "coalesce(s_name, '')"))
        ),
        "json_block": f"""
SELECT source, id, {JSON_BLOCK} AS block
FROM (SELECT 'pages' AS source, page_id AS id, html AS text FROM pages
      UNION ALL SELECT 'events', event_id, 'Answer: ' || props || ' (' || event_type || ')' FROM events)""",
        "trial_stats": statement(
            [TRIALS],
            """SELECT query, model, round(avg_seconds, 6) AS avg_seconds, round(avg_indicators, 6) AS avg_indicators,
       round(success_pct, 6) AS success_pct FROM per_query""",
        ),
        "trial_models": statement([TRIALS], "SELECT * FROM per_model"),
        "trial_winner": statement(
            [TRIALS],
            """SELECT a.model, a.avg_seconds,
       round((b.avg_seconds - a.avg_seconds) / b.avg_seconds * 100, 6) AS gain_pct
FROM (SELECT *, row_number() OVER (ORDER BY avg_seconds, model) AS r FROM per_model) a
JOIN (SELECT *, row_number() OVER (ORDER BY avg_seconds, model) AS r FROM per_model) b ON a.r = 1 AND b.r = 2""",
        ),
    }
