"""DuckDB SQL that states the result of each named query on the same tables."""

from __future__ import annotations

from findloom.functions import text as X
from findloom.model import FIXED_DELIMITER, SENTINEL
from findloom.plans.queries import NEAR, TERMS
from findloom.plans.views_sql import with_views

MARK = X.CITATION_MARK.replace("\n", "' || chr(10) || '")
_list = lambda words: "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"
TOKENS = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"
STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
COSINE = "round(1 - list_dot_product(v, q) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(q, q))), 6) + 0.0"


def _lang(field: str, column: str = "cmetadata") -> str:
    return f"json_extract_string({column}, '$.{field}')"


def _knn(expression: str) -> str:
    return with_views("vectors queries", f"SELECT vec_id, distance FROM (SELECT vec_id, {expression} AS distance FROM vectors, queries WHERE qid = 7) ORDER BY distance, vec_id LIMIT 20")


SCORES = f"scores AS (SELECT doc_id, embed_id, qid, {COSINE} AS distance FROM embedding, queries)"
#: The k nearest of each query, then the nearest over all.
TOP = "hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, doc_id, embed_id) AS rn FROM scores WHERE {where}) WHERE rn <= {k})"
AROUND = f"""wide AS (SELECT doc_id, embed_id + o AS embed_id, min(CASE WHEN o = 0 THEN distance ELSE {SENTINEL}::DOUBLE END) AS distance
  FROM found, (VALUES (-1), (0), (1)) offsets(o) GROUP BY 1, 2)"""
MERGE = """whole AS (SELECT w.doc_id, w.embed_id, w.distance, e.embed_data FROM wide w JOIN embedding e ON w.doc_id = e.doc_id AND w.embed_id = e.embed_id),
  marked AS (SELECT *, CASE WHEN embed_id - lag(embed_id) OVER (PARTITION BY doc_id ORDER BY embed_id) = 1 THEN 0 ELSE 1 END AS starts FROM whole),
  isles AS (SELECT *, sum(starts) OVER (PARTITION BY doc_id ORDER BY embed_id) AS island FROM marked),
  passages AS (SELECT doc_id, rtrim(string_agg(embed_data, ',' ORDER BY embed_id), ',') AS content, min(embed_id) AS embed_id, min(distance) AS distance
    FROM isles GROUP BY doc_id, island)"""
TEXT_ARM = f"""words AS (SELECT doc_id, embed_id, list_filter({TOKENS.format("embed_data")}, lambda t: list_contains({_list(TERMS)}, t)) AS held FROM embedding),
  by_text AS (SELECT doc_id, embed_id, len(list_distinct(held))::BIGINT AS n_terms, len(held)::BIGINT AS hits FROM words WHERE len(held) > 0
    ORDER BY n_terms DESC, hits DESC, doc_id, embed_id LIMIT 20)"""
KEYWORDS = f"""CASE WHEN len(list_filter({_list(TERMS)}, lambda t: contains(lower(content), t))) > 0 THEN
  '(' || len(list_filter({_list(TERMS)}, lambda t: contains(lower(content), t))) || ')[' ||
  array_to_string(list_filter({_list(TERMS)}, lambda t: contains(lower(content), t)), ', ') || ']' ELSE '(0)[No Match]' END"""
COLLAPSE = "regexp_replace(content, '\\n{2,}', chr(10), 'g')"
SOURCE = "doc_id || ':' || doc_id || '.txt'"
LEXICAL = "round((" + " + ".join(f"contains(lower({{}}), '{t}')::INT" for t in TERMS) + f") / {float(len(TERMS))}::DOUBLE, 6)"


def _search(select: str, text_arm: bool = False, rerank: int = 0, extra: str = "") -> str:
    found = "found AS (SELECT doc_id, embed_id, min(distance) AS distance FROM (SELECT doc_id, embed_id, distance FROM hits"
    if text_arm:
        found += " UNION ALL SELECT s.doc_id, s.embed_id, s.distance FROM scores s JOIN by_text b ON s.doc_id = b.doc_id AND s.embed_id = b.embed_id WHERE qid = 7"
    found += ") GROUP BY 1, 2)"
    score = LEXICAL.replace("{}", "content") if rerank else "NULL::DOUBLE"
    ranked = f"scored AS (SELECT *, {score} AS score FROM passages)"
    order = "score DESC, distance, doc_id, embed_id" if rerank else "distance, doc_id, embed_id"
    rows = f"rows AS (SELECT *, {SOURCE} AS source, (row_number() OVER (ORDER BY {order}))::INT AS no FROM scored WHERE {'score >= 0.4' if rerank else 'true'}" + (
        f" QUALIFY no <= {rerank}" if rerank else ""
    ) + ")"
    parts = [SCORES, TOP.format(where=f"distance <= {NEAR}", k=20), *([TEXT_ARM] if text_arm else []), found, AROUND, MERGE, ranked, rows] + ([extra] if extra else [])
    return with_views("embedding queries", select, ", ".join(parts))


RESULT = f"SELECT no, {COLLAPSE} AS content, embed_id, source, CASE WHEN distance < {SENTINEL} THEN distance END AS distance, score, {KEYWORDS} AS key_words FROM rows"

_MARKED_UP = """marked AS (SELECT 'doc_' || page_id AS doc_id, page_id, url FROM pages)"""
_IMAGE_HITS = "hits AS (SELECT *, length(embed_data) * 1000000000000 + substring(doc_id, 5)::BIGINT * 1000000 + embed_id AS rank FROM image_embedding)"
_PAIRS = "pairs AS (SELECT doc_id, img_id, min(rank) AS rank FROM hits GROUP BY 1, 2)"


def _valid_terms() -> str:
    return f"""array_to_string(list_filter(list_transform(list_filter(list_transform(toks, lambda t, i: {{'t': t, 'first': list_position(toks, t) = i}}), lambda s: s.first), lambda s: s.t),
      lambda t: NOT regexp_matches(t, '[0-9\\[\\](){{}}<>]') AND length(t) BETWEEN 3 AND 14 AND NOT list_contains({_list(X.STOP_WORDS)}, lower(t))), ' ')"""


_ONCE = "list_transform(list_filter(list_transform(toks, lambda t, i: {'t': t, 'i': i, 'n': length(t), 'first': list_position(toks, t) = i}), lambda s: s.first), lambda s: {'n': s.n, 'i': s.i, 't': s.t})"

def _office(kind: str, suffix: str = "", sheet: str = "") -> str:
    suffix = suffix or kind
    named = f"'{sheet}'" if sheet else "'doc_' || doc_id"
    return f"""SELECT '/files/doc_' || doc_id || '.{suffix}' AS path, 0::BIGINT AS pos, '{{"source_file":"doc_' || doc_id || '.{suffix}","source_type":"{kind}","block_type":"table_row","sheet":"' || {named} ||
        '","row_start":2,"row_end":2,"fields":{{"lang":"' || lang || '","source":"' || source || '","id":' || doc_id || '}}}} {FIXED_DELIMITER}' AS line FROM documents"""


_PLAIN = "translate(text, " + " || ".join(f"chr({ord(c)})" for c in X.NO_XML) + f", '{' ' * len(X.NO_XML)}')"
#: The lines of each text as elements: the first is a heading, the last is added.
_XML_LINES = f"""WITH cut AS (SELECT doc_id, lang, source, list_transform(string_split({_PLAIN}, chr(10)), lambda x: {STRIP.format("x")}) AS l FROM documents),
        whole AS (SELECT doc_id, lang, source, l[1] AS head, list_append(l[2:], 'end') AS l FROM cut),
        lines AS (SELECT doc_id, lang, source, head, len(l) AS last, generate_subscripts(l, 1) AS no, unnest(l) AS line FROM whole)"""

ORACLE_SQL = {
    "doc_list": with_views("collection", f"SELECT {_lang('file_name')} AS name, id FROM collection"),
    "server_path_lookup": with_views("collection", f"SELECT id, {_lang('server_path')} AS server_path FROM collection WHERE id = 'doc_7'"),
    "document_source_filtered": "SELECT 'doc_' || doc_id AS id, lang, source, md5(text) AS data_md5 FROM documents WHERE lang IN ('fr', 'de')",
    "metadata_filter": with_views("collection embedding", f"SELECT doc_id, embed_id FROM embedding WHERE doc_id IN (SELECT id FROM collection WHERE {_lang('lang')} = 'fr')"),
    "doc_id_filter": with_views("embedding", "SELECT doc_id, embed_id FROM embedding WHERE doc_id IN ('doc_3', 'doc_14', 'doc_15')"),
    "scan_with_collection": with_views("collection embedding", f"SELECT doc_id, embed_id, {_lang('file_name')} AS name, length(embed_data) AS chars FROM embedding JOIN collection ON doc_id = id"),
    "knn_cosine": _knn(COSINE),
    "knn_euclidean": _knn("round(list_distance(v, q), 6) + 0.0"),
    "knn_dot": _knn("round(-list_dot_product(v, q), 6) + 0.0"),
    "knn_threshold": with_views("embedding queries", "SELECT doc_id, embed_id, distance FROM scores WHERE qid = 7 AND distance <= 0.7", SCORES),
    "knn_partitioned_topk": with_views(
        "embedding queries",
        "SELECT doc_id, embed_id, distance FROM top WHERE rn <= 2 AND doc_id IN (SELECT doc_id FROM top WHERE rn = 1 ORDER BY distance, doc_id LIMIT 5)",
        f"{SCORES}, top AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY distance, embed_id) AS rn FROM scores WHERE qid = 7 AND distance <= {NEAR})",
    ),
    "multi_query_fusion": with_views("embedding queries", "SELECT doc_id, embed_id, min(distance) AS distance FROM hits GROUP BY 1, 2", f"{SCORES}, {TOP.format(where=f'distance <= {NEAR}', k=20)}"),
    "multi_step_query": with_views(
        "embedding",
        "SELECT doc_id, embed_id, min(distance) AS distance FROM hits GROUP BY 1, 2",
        f"""base AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 7),
        near AS (SELECT doc_id, embed_id, v, {COSINE} AS distance FROM embedding, base ORDER BY distance, doc_id, embed_id LIMIT 3),
        subs AS (SELECT 0 AS qid, q FROM base UNION ALL SELECT row_number() OVER (ORDER BY distance, doc_id, embed_id), v FROM near),
        scores AS (SELECT doc_id, embed_id, qid, {COSINE} AS distance FROM embedding, subs), {TOP.format(where="true", k=10)}""",
    ),
    "neighbor_expand": with_views(
        "embedding queries",
        "SELECT doc_id, embed_id, w.distance FROM wide w JOIN embedding USING (doc_id, embed_id)",
        f"{SCORES}, {TOP.format(where=f'qid = 7 AND distance <= {NEAR}', k=20)}, found AS (SELECT * FROM hits), {AROUND}",
    ),
    "merge_adjacent_chunks": with_views(
        "embedding queries",
        "SELECT doc_id, embed_id, distance, content FROM passages",
        f"{SCORES}, {TOP.format(where=f'qid = 7 AND distance <= {NEAR}', k=20)}, found AS (SELECT * FROM hits), {AROUND}, {MERGE}",
    ),
    "first_chunk_extend": with_views("embedding", "SELECT doc_id, min(embed_id) AS embed_id, rtrim(string_agg(embed_data, ',' ORDER BY embed_id), ',') AS content FROM embedding WHERE embed_id <= 10002 GROUP BY doc_id"),
    "hybrid_search_flagship": _search(RESULT, text_arm=True),
    "hybrid_search_reranked": _search(RESULT, text_arm=True, rerank=10),
    "hybrid_search_extend_first": _search(
        f"""SELECT (row_number() OVER (ORDER BY lead, is_hit, was))::INT AS no, {COLLAPSE} AS content, embed_id, source,
          CASE WHEN distance < {SENTINEL} THEN distance END AS distance, score, {KEYWORDS} AS key_words FROM every""",
        extra="""led AS (SELECT *, min(no) OVER (PARTITION BY source) AS lead FROM rows),
          heads AS (SELECT doc_id, min(embed_id) AS embed_id, rtrim(string_agg(embed_data, ',' ORDER BY embed_id), ',') AS content FROM embedding WHERE embed_id <= 10002 GROUP BY doc_id),
          every AS (SELECT doc_id, content, embed_id, distance, score, source, lead, 1 AS is_hit, no AS was FROM led
            UNION ALL SELECT h.doc_id, h.content, h.embed_id, NULL, NULL, l.source, l.lead, 0, 0 FROM (SELECT DISTINCT doc_id, source, lead FROM led) l JOIN heads h USING (doc_id))""",
    ),
    "answer_by_one": _search(f"SELECT no, embed_id, source, CASE WHEN distance < {SENTINEL} THEN distance END AS distance FROM rows WHERE source = (SELECT source FROM rows WHERE no = 1)"),
    "vision_search": with_views(
        "collection image_chunks queries",
        RESULT,
        f"""{SCORES.replace("FROM embedding", "FROM image_chunks")}, {TOP.format(where=f"qid = 7 AND distance <= {NEAR}", k=20)},
        rows AS (SELECT h.doc_id, h.embed_id, embed_data AS content, distance, NULL::DOUBLE AS score, h.doc_id || ':' || h.doc_id || '.txt' AS source,
          (row_number() OVER (ORDER BY distance, h.doc_id, h.embed_id))::INT AS no FROM hits h JOIN image_chunks e ON h.doc_id = e.doc_id AND h.embed_id = e.embed_id
          JOIN collection c ON c.id = h.doc_id)""",
    ),
    "provider_rerank": with_views(
        "embedding queries",
        f"SELECT no, embed_id, {SOURCE} AS source, distance, score FROM rows",
        f"""{SCORES}, {TOP.format(where=f"qid = 7 AND distance <= {NEAR}", k=20)}, wide AS (SELECT doc_id, embed_id, distance FROM hits), {MERGE},
        rows AS (SELECT *, (contains(lower(content), 'the')::INT + contains(lower(content), 'and')::INT) / 2.0::DOUBLE AS score,
          (row_number() OVER (ORDER BY score DESC, distance, doc_id, embed_id))::INT AS no FROM passages QUALIFY no <= 10)""",
    ),
    "query_expansion": with_views(
        "qa_result",
        "SELECT query_id, 0::BIGINT AS qid, query FROM asked UNION ALL SELECT query_id, unnest(range(1, len(more) + 1)), unnest(more) FROM made",
        f"""asked AS (SELECT query_id, query FROM qa_result WHERE {STRIP.format("query")} <> ''),
        made AS (SELECT query_id, list_filter(list_transform(string_split(string_split({STRIP.format("query")}, chr(10))[-1], '. '),
          lambda s: {STRIP.format("s")}), lambda s: s <> '')[1:3] AS more FROM asked)""",
    ),
    "document_ingestion": with_views(
        "embedding lines",
        """SELECT doc_id, embed_id, md5(embed_data) AS data_md5, len(v)::BIGINT AS dimensions FROM embedding WHERE substring(doc_id, 5)::BIGINT % 2 = 1
          UNION ALL SELECT 'doc_' || doc_id, 10000 + row_number() OVER (PARTITION BY doc_id ORDER BY pos), md5(piece), 64 FROM lines WHERE doc_id % 2 = 0 AND trim(piece) <> ''""",
    ),
    "image_prompt_groups": with_views(
        "image_embedding",
        """SELECT 1::BIGINT AS mode, row_number() OVER (ORDER BY rank) AS place, doc_id AS doc_ids, img_id::VARCHAR AS img_ids FROM top
          UNION ALL SELECT 2, 1, string_agg(doc_id, ',' ORDER BY img_id, doc_id), string_agg(img_id::VARCHAR, ',' ORDER BY img_id, doc_id) FROM top
          UNION ALL SELECT 3, row_number() OVER (ORDER BY min(rank)), string_agg(doc_id, ',' ORDER BY img_id), string_agg(img_id::VARCHAR, ',' ORDER BY img_id) FROM top GROUP BY doc_id""",
        f"{_IMAGE_HITS}, {_PAIRS}, top AS (SELECT * FROM pairs ORDER BY rank, doc_id, img_id LIMIT 5)",
    ),
    "vector_cast": "SELECT vec_id, len(embedding)::BIGINT AS dimensions, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings",
    "blob_cast": "SELECT doc_id, octet_length(encode(text))::BIGINT AS n_bytes, md5(text) AS blob_md5 FROM documents",
    "result_presentation": _search(
        f"""SELECT no::VARCHAR AS "NO", {COLLAPSE} AS "CONTENT", embed_id::VARCHAR AS "EMBED_ID", source AS "SOURCE",
          CASE WHEN distance < {SENTINEL} THEN distance::VARCHAR ELSE '-' END AS "DISTANCE", '-' AS "SCORE", {KEYWORDS} AS "KEY_WORDS" FROM rows"""
    ),
    "result_numbering": _search("SELECT no, source, embed_id FROM rows"),
    "text_search_accum": with_views("embedding", "SELECT * FROM by_text", TEXT_ARM),
    "text_search_scan": with_views("embedding", "SELECT * FROM by_text", TEXT_ARM),
    "text_search_many": with_views(
        "embedding",
        """SELECT item_id, rank, doc_id, embed_id, n_terms, hits FROM (
          SELECT *, (row_number() OVER (PARTITION BY item_id ORDER BY n_terms DESC, hits DESC, doc_id, embed_id))::INT AS rank FROM found) WHERE rank <= 10""",
        f"""words AS (SELECT item_id, unnest(list_distinct({TOKENS.format("text")})) AS t FROM benchmark),
        terms AS (SELECT item_id, t FROM words QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY length(t) DESC, t) <= 4),
        held AS (SELECT doc_id, embed_id, unnest({TOKENS.format("embed_data")}) AS t FROM embedding),
        found AS (SELECT item_id, doc_id, embed_id, count(DISTINCT t) AS n_terms, count(*) AS hits FROM held JOIN terms USING (t) GROUP BY ALL)""",
    ),
    "text_predicate": with_views("embedding", "SELECT doc_id, embed_id, len(list_distinct(held)) AS n_terms, len(held) AS hits FROM words WHERE len(held) > 0", TEXT_ARM.split(",\n  by_text")[0]),
    "text_index_upkeep": with_views(
        "embedding",
        "SELECT doc_id, embed_id, len(list_distinct(held)) AS n_terms, len(held) AS hits FROM words WHERE len(held) > 0 ORDER BY n_terms DESC, hits DESC, doc_id, embed_id LIMIT 50",
        f"""changed AS (SELECT doc_id, embed_id, CASE WHEN doc_id LIKE '%7' THEN reverse(embed_data) ELSE embed_data END AS embed_data FROM embedding
          WHERE doc_id NOT LIKE '%3' AND embed_id % 9 <> 0),
        {TEXT_ARM.split(",\n  by_text")[0].replace("FROM embedding", "FROM changed")}""",
    ),
    "keyword_cut_shortest": f"""WITH t AS (SELECT doc_id, {TOKENS.format("text")} AS toks FROM documents), o AS (SELECT doc_id, {_ONCE} AS once FROM t)
        SELECT doc_id, array_to_string(list_transform(CASE WHEN len(once) <= 6 THEN once ELSE list_sort(once)[1:6] END, lambda s: s.t), ' ') AS terms FROM o""",
    "token_filter_stopwords": f"WITH t AS (SELECT conv_id, turn, {TOKENS.format('text')} AS toks FROM conversations) SELECT conv_id, turn, {_valid_terms()} AS terms FROM t",
    "keyword_highlight": with_views("embedding", f"SELECT doc_id, embed_id, {KEYWORDS} AS key_words FROM (SELECT *, embed_data AS content FROM embedding)"),
    "collapse_newlines": "SELECT doc_id, md5(regexp_replace(text, '\\n+', chr(10), 'g')) AS text_md5 FROM documents",
    "control_char_scrub": "SELECT doc_id, md5(translate(text, 'en', chr(10) || ' ')) AS text_md5 FROM documents",
    "rerank_lexical_topk": with_views(
        "embedding queries",
        f"""SELECT doc_id, embed_id, distance, score FROM (SELECT h.doc_id, h.embed_id, h.distance, {LEXICAL.replace("{}", "embed_data")} AS score
          FROM hits h JOIN embedding e ON h.doc_id = e.doc_id AND h.embed_id = e.embed_id) WHERE score >= 0.4 ORDER BY score DESC, distance, doc_id, embed_id LIMIT 5""",
        f"{SCORES}, {TOP.format(where='qid = 7', k=50)}",
    ),
    "fixed_delimiter_split": r"""WITH p AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\S')) AS l FROM documents)
        SELECT doc_id, (generate_subscripts(l, 1) - 1)::INT AS pos, unnest(l) AS piece FROM p""",
    "chunk_offsets": with_views(
        "lines",
        """SELECT doc_id, chunk_id, chunk_offset, chunk_length, md5(piece) AS chunk_md5 FROM (SELECT doc_id, pos + 10001 AS chunk_id, length(piece) AS chunk_length, piece,
          coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + 1 AS chunk_offset FROM lines) WHERE chunk_length > 0""",
    ),
    "chunk_overlap_prefix": with_views("lines", "SELECT doc_id, pos, md5(coalesce(right(lag(piece) OVER (PARTITION BY doc_id ORDER BY pos), 32), '') || piece) AS piece_md5 FROM lines"),
    "image_block_extract": f"WITH {_MARKED_UP} SELECT doc_id, unnest([1, 2])::BIGINT AS img_id, {STRIP.format('url')} AS text_data, 'seen ' || page_id AS vlm_data, 'QUJD' || page_id AS base64_data FROM marked",
    "ocr_text_extract": f"WITH {_MARKED_UP} SELECT doc_id, {STRIP.format('url')} || chr(10) || {STRIP.format('url')} AS text FROM marked",
    "image_first_chunk_per_image": with_views("image_embedding", "SELECT doc_id, img_id, min(embed_id) AS embed_id FROM image_embedding GROUP BY 1, 2"),
    "image_hits_in_order": with_views(
        "image_embedding",
        "SELECT f.rank, f.doc_id, f.img_id, length(base64_data) AS chars FROM f JOIN image i ON f.doc_id = i.doc_id AND f.img_id = i.img_id WHERE base64_data <> ''",
        f"{_IMAGE_HITS}, f AS (SELECT doc_id, img_id, arg_min(rank, embed_id) AS rank FROM hits GROUP BY 1, 2)",
    ),
    "image_limit_ordered": with_views("image_embedding", "SELECT doc_id, img_id, rank FROM pairs ORDER BY rank, doc_id, img_id LIMIT 3", f"{_IMAGE_HITS}, {_PAIRS}"),
    "image_group_by_file": with_views("image_embedding", "SELECT doc_id, min(rank) AS rank, string_agg(DISTINCT img_id::VARCHAR, ',' ORDER BY img_id::VARCHAR) AS img_ids FROM hits GROUP BY doc_id", _IMAGE_HITS),
    "image_first_last": with_views("image", "SELECT doc_id, min(img_id) AS img_id FROM image GROUP BY 1 UNION SELECT doc_id, max(img_id) FROM image GROUP BY 1"),
    "image_neighbors": with_views(
        "image_embedding",
        """SELECT doc_id, img_id FROM top UNION SELECT doc_id, min(img_id) FROM image WHERE doc_id IN (SELECT doc_id FROM top) GROUP BY 1
          UNION SELECT doc_id, max(img_id) FROM image WHERE doc_id IN (SELECT doc_id FROM top) GROUP BY 1
          UNION SELECT i.doc_id, i.img_id FROM image i JOIN top t ON i.doc_id = t.doc_id AND abs(i.img_id - t.img_id) = 1""",
        f"{_IMAGE_HITS}, {_PAIRS}, top AS (SELECT * FROM pairs ORDER BY rank, doc_id, img_id LIMIT 3)",
    ),
    "image_embedding_rows": with_views(
        "image",
        f"SELECT doc_id, img_id, data_type, base + row_number() OVER (PARTITION BY doc_id, data_type ORDER BY img_id) AS embed_id, {STRIP.format('embed_data')} AS embed_data FROM r",
        """r AS (SELECT doc_id, img_id, 'text_data' AS data_type, 10000 AS base, text_data AS embed_data FROM image WHERE text_data <> ''
          UNION ALL SELECT doc_id, img_id, 'vlm_data', 30000, vlm_data FROM image WHERE vlm_data <> ''
          UNION ALL SELECT doc_id, img_id, 'base64_data', 50000, 'これは画像です' FROM image WHERE base64_data <> '')""",
    ),
    "base64_scrub": "SELECT page_id, url || '  b  ' || substring(html, 1, 200) || '  d' AS clean FROM pages",
    "image_format_sniff": """WITH s AS (SELECT page_id, ['/9j/', 'iVBORw0KGgo', 'R0lGODlh', 'UklGR', 'data:image/gif;base64,', 'zz'][page_id % 6 + 1] || page_id AS data,
        ['jpeg', 'png', 'gif', 'webp', 'jpeg', 'jpeg'][page_id % 6 + 1] AS format FROM pages)
        SELECT page_id, format, CASE WHEN data LIKE 'data:%' THEN data ELSE 'data:image/' || format || ';base64,' || data END AS uri FROM s""",
    "citation_split": f"SELECT conv_id, turn, CASE WHEN turn % 4 = 1 THEN md5({STRIP.format('text')}) END AS answer_md5, CASE WHEN turn % 4 = 1 THEN role END AS citation FROM conversations",
    "citation_join": with_views(
        "embedding",
        """SELECT answer_id, place, embed_id::VARCHAR AS embed_id, source, replace(replace(replace(coalesce(content, 'N/A'), '"', ''''), chr(10), ' '), chr(13), ' ') AS content
        FROM asked LEFT JOIN (SELECT doc_id || ':' || doc_id || '.txt' AS s, embed_id AS i, embed_data AS content FROM embedding) ON s = source AND i = embed_id""",
        """asked AS (SELECT conv_id * 1000 + turn AS answer_id, 'doc_' || conv_id || ':doc_' || conv_id || '.txt' AS source, place, [10001 + turn % 5, 10099][place + 1] AS embed_id
          FROM conversations, (VALUES (0::BIGINT), (1)) p(place))""",
    ),
    "strip_timing_line": "SELECT conv_id, turn, md5(regexp_replace(text, '\\n$', '')) AS text_md5 FROM conversations WHERE role = 'assistant'",
    "evaluation_report": with_views(
        "qa_result qa_feedback",
        """SELECT r.query_id, query, standard_answer, strftime(created_date, '%Y-%m-%d %H:%M:%S') AS created_date, llm_name, llm_answer, human_evaluation_result
          FROM qa_result r LEFT JOIN qa_feedback f ON r.query_id = f.query_id""",
    ),
    "feedback_explode": """WITH t AS (SELECT conv_id, max(CASE WHEN turn % 4 = 1 THEN text END) AS a, max(CASE WHEN turn % 4 = 3 THEN text END) AS b FROM conversations WHERE role = 'assistant' GROUP BY conv_id)
        SELECT 'query_' || conv_id AS query_id, 'm1' AS llm_name, a AS llm_answer, a AS vlm_answer, '8' AS ragas_evaluation_result FROM t WHERE a IS NOT NULL
        UNION ALL SELECT 'query_' || conv_id, 'm2', b, b, '6' FROM t WHERE b IS NOT NULL""",
    "result_capture": """WITH t AS (SELECT conv_id, max(CASE WHEN turn = 0 THEN text END) AS q, max(CASE WHEN turn = 1 THEN text END) AS a, max(CASE WHEN turn = 3 THEN text END) AS b
          FROM conversations GROUP BY conv_id),
        kept AS (SELECT * FROM t WHERE conv_id % 5 <> 0 AND coalesce(q, '') <> ''),
        feedback AS (SELECT conv_id, 'm1' AS llm_name, md5(a) AS answer_md5 FROM kept WHERE a IS NOT NULL UNION ALL SELECT conv_id, 'm2', md5(b) FROM kept WHERE b IS NOT NULL)
        SELECT 'query_' || k.conv_id AS query_id, md5(q) AS query_md5, NULL::VARCHAR AS standard_answer, 'select ' || k.conv_id AS sql, llm_name, answer_md5,
          CASE WHEN llm_name IS NOT NULL THEN '' END AS ragas_evaluation_result FROM kept k LEFT JOIN feedback f USING (conv_id)""",
    "judge_marks": """WITH m AS (SELECT conv_id, turn, (conv_id % 12)::DOUBLE AS correctness, (turn % 11)::DOUBLE AS completeness, ((conv_id + turn) % 10)::DOUBLE AS relevance,
          (turn % 3)::DOUBLE + 0.5 AS clarity FROM conversations)
        SELECT conv_id, turn, CASE WHEN correctness <= 10 THEN correctness END AS correctness, CASE WHEN correctness <= 10 THEN completeness END AS completeness,
          CASE WHEN correctness <= 10 THEN relevance END AS relevance, CASE WHEN correctness <= 10 THEN clarity END AS clarity FROM m""",
    "image_text_split": with_views(
        "image",
        """SELECT doc_id, img_id, k AS pos, substring(t, k * 231 + 1, 256) AS piece
          FROM (SELECT doc_id, img_id, t, unnest(range(CASE WHEN length(t) <= 256 THEN 1 ELSE (length(t) - 25 + 230) // 231 END)) AS k FROM texts)""",
        "texts AS (SELECT doc_id, img_id, repeat(md5(text_data), 1 + img_id * length(text_data) % 40) AS t FROM image)",
    ),
    "knn_many": with_views(
        "vectors",
        f"""SELECT query_id, rank, vec_id, distance FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id))::INT AS rank FROM near) WHERE rank <= 10""",
        f"""near AS (SELECT a.vec_id AS query_id, b.vec_id, {COSINE.replace("(v, q)", "(a.v, b.v)").replace("(v, v)", "(a.v, a.v)").replace("(q, q)", "(b.v, b.v)")} AS distance
          FROM vectors a, vectors b WHERE a.vec_id % 100 = 0)""",
    ),
    "human_feedback_update": with_views(
        "qa_feedback",
        """SELECT f.query_id, llm_name, md5(llm_answer) AS answer_md5,
          CASE WHEN llm_name = 'model_1' AND turn IS NOT NULL THEN CASE WHEN turn % 4 = 0 THEN 'good' ELSE 'bad' END ELSE human_evaluation_result END AS human_evaluation_result,
          CASE WHEN llm_name = 'model_1' THEN turn::VARCHAR END AS user_comment FROM qa_feedback f LEFT JOIN last USING (query_id)""",
        "last AS (SELECT 'query_' || conv_id AS query_id, max(turn) AS turn FROM conversations WHERE role = 'user' GROUP BY conv_id)",
    ),
    "cascade_delete": with_views(
        "collection embedding image_embedding",
        """SELECT 'collection' AS table_name, count(*) AS rows_left FROM collection WHERE id NOT IN (SELECT id FROM gone)
          UNION ALL SELECT 'embedding', count(*) FROM embedding WHERE doc_id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'image', count(*) FROM image WHERE doc_id NOT IN (SELECT id FROM gone)
          UNION ALL SELECT 'image_embedding', count(*) FROM image_embedding WHERE doc_id NOT IN (SELECT id FROM gone)""",
        "gone AS (SELECT id FROM collection WHERE id LIKE '%3')",
    ),
    "chunk_replace": with_views(
        "embedding",
        """SELECT doc_id, embed_id, md5(embed_data) AS data_md5 FROM embedding WHERE doc_id NOT IN (SELECT doc_id FROM fresh) UNION ALL SELECT doc_id, embed_id, md5('new ' || embed_data) FROM fresh""",
        "fresh AS (SELECT * FROM embedding WHERE doc_id LIKE '%7' AND embed_id % 2 = 1)",
    ),
    "pending_vectors": with_views("embedding", "SELECT doc_id, embed_id FROM embedding WHERE embed_id % 3 = 0"),
    "vector_update": with_views("embedding", "SELECT doc_id, embed_id, embed_id % 3 <> 0 OR doc_id LIKE '%1' AS has_vector FROM embedding"),
    "metadata_parse": "SELECT doc_id, 'doc_' || doc_id || '.txt' AS file_name, source AS dept, 'a=b' AS rule, lang FROM documents",
    "jsonl_sink_format": f"""SELECT doc_id, '{{"doc_id":' || doc_id || ',"lang":"' || lang || '","source":"' || source || '"}} {FIXED_DELIMITER}' AS line FROM documents""",
    "json_array_lines": f"""SELECT doc_id, 0::BIGINT AS pos, '{{"a": ' || doc_id || '}} {FIXED_DELIMITER}' AS line FROM documents WHERE doc_id % 2 = 0
        UNION ALL SELECT doc_id, 1, '2 {FIXED_DELIMITER}' FROM documents WHERE doc_id % 2 = 0""",
    "snowflake_id": "SELECT event_id, 'doc_' || (((epoch_us(ts) // 1000 - 1288834974657) << 22) | (1 << 17) | (1 << 12) | (event_id % 4096)) AS id FROM events",
    "hashed_ids": with_views("collection", "SELECT id, upper(substring(sha256(id), 1, 16)) AS hashed FROM collection"),
    "preview_text": "SELECT doc_id, md5(CASE WHEN length(text) > 1000 THEN substring(text, 1, 1000) || ' ...' ELSE text END) AS preview_md5 FROM documents",
    "prompt_render": with_views("qa_result", "SELECT query_id, 'Context: ' || standard_answer || chr(10) || 'Question: ' || query AS prompt FROM qa_result"),
    "download_sheet": with_views("qa_feedback", f"SELECT llm_name, md5({STRIP.format('llm_answer')}) AS answer_md5, 'cited' AS citation, 'v' AS vlm_answer, '8' AS ragas_evaluation_result FROM qa_feedback"),
    "csv_blocks": _office("csv"),
    "excel_blocks": _office("excel", "xlsx", "Data"),
    "word_blocks": f"""SELECT '/files/doc_' || doc_id || '.docx' AS path, 0::BIGINT AS pos, '{{"source_file":"doc_' || doc_id ||
        '.docx","source_type":"word","block_type":"word_section","section_path":["' || source || '"],"row_start":3,"row_end":4,"content":"written in ' || lang || '\\n- number ' || doc_id || '"}} {FIXED_DELIMITER}' AS line
        FROM documents UNION ALL SELECT '/files/doc_' || doc_id || '.docx', 1, '{{"source_file":"doc_' || doc_id || '.docx","source_type":"word","block_type":"word_table_row","section_path":["' || source ||
        '"],"table_index":1,"row_start":2,"row_end":2,"body_index":4,"fields":{{"lang":"' || lang || '","id":"' || doc_id || '"}}}} {FIXED_DELIMITER}' FROM documents""",
    "xml_to_blocks": f"""{_XML_LINES}
        SELECT doc_id, no - 1 AS pos, md5('{{"id": "' || no || '", "m@kind": "' || lang || '"' || coalesce(', "h": ' || to_json(nullif(concat_ws(chr(10), CASE WHEN no = 1 THEN nullif(head, '') END, CASE WHEN no = last THEN source END), ''))::VARCHAR, '') || CASE WHEN line <> '' THEN ', "p": ' || to_json(line)::VARCHAR ELSE '' END || '}} {FIXED_DELIMITER}') AS line_md5 FROM lines""",
    "xml_to_blocks_merged": f"""{_XML_LINES},
        runs AS (SELECT doc_id, lang, any_value(source) AS source, any_value(head) AS head, string_agg(line, chr(10) ORDER BY no) FILTER (line <> '' AND no < last) AS body FROM lines GROUP BY doc_id, lang)
        SELECT doc_id, 0::BIGINT AS pos, md5('{{"id": "1", "m@kind": "' || lang || '"' || CASE WHEN body IS NULL THEN ', "h": ' || to_json(CASE WHEN head <> '' THEN head || chr(10) ELSE '' END || source)::VARCHAR || ', "p": "end"'
          ELSE CASE WHEN head <> '' THEN ', "h": ' || to_json(head)::VARCHAR ELSE '' END || ', "p": ' || to_json(body)::VARCHAR END || '}} {FIXED_DELIMITER}') AS line_md5 FROM runs
        UNION ALL SELECT doc_id, 1, md5('{{"id": "2", "m@kind": "' || lang || '", "h": ' || to_json(source)::VARCHAR || ', "p": "end"}} {FIXED_DELIMITER}') FROM runs WHERE body IS NOT NULL""",
}
