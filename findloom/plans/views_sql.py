"""The fixture views in DuckDB SQL, as common table expressions."""

from __future__ import annotations

VIEWS = {
    "collection": """SELECT 'doc_' || doc_id AS id, text AS data,
      '{"file_name": "doc_' || doc_id || '.txt", "source": "' || source || '", "server_path": "/files/doc_' || doc_id || '.txt", "lang": "' || lang || '"}' AS cmetadata
      FROM documents""",
    "embedding": """SELECT 'doc_' || doc_id AS doc_id, 10001 + k AS embed_id, substring(text, k * 320 + 1, 320) AS embed_data, embedding::DOUBLE[] AS v
      FROM (SELECT doc_id, text, unnest(range((length(text) + 319) // 320)) AS k FROM documents WHERE text <> '')
      JOIN embeddings ON vec_id = (doc_id * 5 + k) % (SELECT count(*) FROM embeddings)""",
    "image": """SELECT 'doc_' || (page_id // 5) AS doc_id, page_id % 5 + 1 AS img_id, url AS text_data,
      regexp_extract(html, '<title>([^<]*)</title>', 1) AS vlm_data, base64(encode(html)) AS base64_data FROM pages""",
    "image_embedding": """SELECT doc_id, base + img_id AS embed_id, embed_data, img_id FROM (
      SELECT doc_id, img_id, 10000 AS base, text_data AS embed_data FROM image UNION ALL SELECT doc_id, img_id, 30000, vlm_data FROM image
      UNION ALL SELECT doc_id, img_id, 50000, 'image' FROM image)""",
    "image_chunks": """SELECT doc_id, embed_id, embed_data, img_id, embedding::DOUBLE[] AS v FROM image_embedding
      JOIN embeddings ON vec_id = (substring(doc_id, 5)::BIGINT * 7 + embed_id) % (SELECT count(*) FROM embeddings)""",
    "qa_result": """SELECT 'query_' || conv_id AS query_id, arg_min(text, turn) AS query, 'standard ' || conv_id AS standard_answer,
      make_timestamp((1700000000 + conv_id) * 1000000) AS created_date FROM conversations WHERE role = 'user' GROUP BY conv_id""",
    "qa_feedback": """SELECT 'query_' || conv_id AS query_id, 'model_' || (turn % 4) AS llm_name, text AS llm_answer,
      CASE WHEN length(text) % 2 = 0 THEN 'good' ELSE 'bad' END AS human_evaluation_result FROM conversations WHERE role = 'assistant'""",
    "queries": "SELECT vec_id AS qid, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id IN (7, 77, 177, 277)",
    "vectors": "SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings",
    "lines": """SELECT doc_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS piece FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)""",
}
NEEDS = {"image_embedding": ["image"], "image_chunks": ["image", "image_embedding"]}


def with_views(names: str, body: str, more: str = "") -> str:
    wanted: list[str] = []
    for name in names.split():
        wanted += [n for n in [*NEEDS.get(name, []), name] if n not in wanted]
    parts = [f"{n} AS ({VIEWS[n]})" for n in wanted] + ([more] if more else [])
    return (f"WITH {', '.join(parts)} " if parts else "") + body
