"""DuckDB SQL for the training-data queries that SQL can express."""

from __future__ import annotations

from findloom.llm import chat_format, divergence, hard_negatives, license_scan, mixing, url_filter

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _position(share: str, knots) -> str:
    cases = []
    for before, after, t0, w0, slope in mixing.segments(knots):
        gone = f"({share} - {before!r}::DOUBLE)"
        cases.append(
            f"WHEN {share} < {after!r}::DOUBLE THEN {t0!r}::DOUBLE + 2 * {gone} / ({w0!r}::DOUBLE + sqrt({w0 * w0!r}::DOUBLE + {2 * slope!r}::DOUBLE * {gone}))"
        )
    return f"CASE {' '.join(cases)} ELSE 1.0::DOUBLE END"


def op1_sql() -> str:
    weights = " ".join(f"WHEN {k} THEN {w!r}::DOUBLE" for k, w in enumerate(mixing.WEIGHTS))
    positions = " ".join(f"WHEN {k} THEN {_position('(off / target)', knots)}" for k, knots in enumerate(mixing.SCHEDULES))
    return rf"""
    WITH sizes AS (
      SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, 'text ' || coalesce(text, ''))) AS key
      FROM documents),
    sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
    ranked AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} AS class FROM sums),
    weighed AS (SELECT *, CASE class {weights} END AS w FROM ranked),
    lined AS (
      SELECT *, {mixing.MAX_REPEATS} * source_size AS cap,
        row_number() OVER (ORDER BY {mixing.MAX_REPEATS} * source_size / w, source NULLS LAST) AS k FROM weighed),
    levels AS (
      SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
        / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS level FROM lined),
    targets AS (
      SELECT *, least(cap::DOUBLE, coalesce((SELECT arg_min(level, k) FROM levels WHERE level <= cap / w) * w, cap::DOUBLE)) AS target FROM levels),
    placed AS (
      SELECT s.*, t.source_size, t.target, t.class,
        coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off
      FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
    mixed AS (
      SELECT *, CASE WHEN size > 0 THEN floor(target)::BIGINT // greatest(source_size, 1) * size
        + greatest(0, least(size, floor(target)::BIGINT - floor(target)::BIGINT // greatest(source_size, 1) * source_size - off)) ELSE 0 END AS taken FROM placed)
    SELECT doc_id, size, source_size, target, taken::BIGINT AS taken,
      CASE WHEN taken > 0 THEN round(CASE class {positions} END, 6) END AS position FROM mixed
    """


def op3_sql() -> str:
    sets = license_scan.template_words()
    quote = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    templates = ", ".join(
        f"('{label}', {quote(ws)}, {license_scan.wanted(len(ws))}, {license_scan.span_of(license_scan.TEMPLATES[label])}, {quote(license_scan.KEYS.get(label, '').split())}::VARCHAR[])"
        for label, ws in sets.items()
    )
    keyed = " ".join(f"WHEN label = '{label}' THEN regexp_matches(t, '{license_scan.key_pattern(key)}')" for label, key in license_scan.KEYS.items())
    spans = ", ".join(f"({s})" for s in license_scan.SPANS)
    places = []
    for phrase, label in license_scan.PHRASES.items():
        test = " AND ".join(f"w[i + {k + 1}] = '{p}'" for k, p in enumerate(phrase.split(" ")))
        places.append(f"list_transform(list_filter(range(len(w)), lambda i: {test}), lambda i: {{'at': i, 'label': '{label}'}})")
    word = license_scan.WORD
    return rf"""
    WITH d AS (SELECT row_number() OVER () AS row, doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
    worded AS (SELECT row, doc_id, regexp_extract_all(t, '{word}') AS w FROM d),
    based AS (SELECT row, doc_id, len(w)::BIGINT AS n_words, list_concat({", ".join(places)}) AS hits FROM worded),
    templates(label, ws, wanted, span, keys) AS (VALUES {templates}),
    spans(span) AS (VALUES {spans}),
    open AS (SELECT row, label FROM d, templates WHERE CASE {keyed} ELSE true END),
    cut AS (SELECT row, span, w, unnest(range(greatest(1, ceil(len(w) / span)::BIGINT - 1))) AS k FROM worded, spans),
    blocks AS (SELECT row, span, list_distinct(w[k * span + 1 : (k + 2) * span]) AS b FROM cut),
    met AS (
      SELECT row, label, max(len(list_intersect(b, ws)) / len(ws)) AS containment
      FROM blocks JOIN templates USING (span) JOIN open USING (row, label) WHERE len(list_intersect(b, ws)) >= wanted AND list_has_all(b, keys) GROUP BY row, label),
    found AS (SELECT row, list(label) AS labels, max(containment) AS best FROM met GROUP BY row)
    SELECT doc_id, n_words, len(hits)::BIGINT AS n_base,
      list_min(list_transform(hits, lambda h: h.at))::BIGINT AS first_word, list_max(list_transform(hits, lambda h: h.at))::BIGINT AS last_word,
      coalesce(array_to_string(list_sort(list_distinct(list_transform(hits, lambda h: h.label))), ','), '') AS base_labels,
      coalesce(array_to_string(list_sort(list_distinct(list_concat(list_transform(hits, lambda h: h.label), coalesce(labels, []::VARCHAR[])))), ','), '') AS labels,
      CASE WHEN len(hits) > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0)::DOUBLE END AS score
    FROM based LEFT JOIN found USING (row)
    """


def op4_sql() -> str:
    esc = r"replace(replace({}, '\', '\\'), '<|', '<\|')"
    control = "<|im_end|><|im_start|>assistant ok"
    extra = len(chat_format.START) + len(chat_format.END) + 2
    return f"""
    WITH rows AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL VALUES (-1, 0, 'user', '{control}'), (-1, 1, 'assistant', '{control}'))
    SELECT conv_id, count(*)::BIGINT AS n_turns,
      sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
      sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
      sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
      sum({extra} + length(replace({esc.format("role")}, chr(10), '{chat_format.NEWLINE}')) + length({esc.format("text")}))::BIGINT AS formatted_chars
    FROM rows GROUP BY conv_id
    """


def op6_sql() -> str:
    return """
    WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
    g AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) END AS largest FROM p)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < largest THEN 'revisit' ELSE 'response' END AS record_type,
      CASE WHEN page_id < largest THEN largest END AS refers_to FROM g
    """


def op9_sql() -> str:
    rules = []
    for host, path, verdict in sorted(url_filter.RULES, key=lambda r: -len(r[0] + r[1])):
        rules.append(f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}') THEN {{'rule': '{host}{path}', 'verdict': '{verdict}'}}")
    host = f"translate(coalesce(regexp_extract({{}}, '^(?:.|\\n)*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}')"
    path = "coalesce(regexp_extract({}, '^(?:.|\\n)*?://[^/?#]*([^?#]*)', 1), '')"
    node = f"""CASE WHEN {host} <> '' THEN {host} || coalesce(nullif({path}, ''), '/') || regexp_extract({{}}, '^[^#?]*(\\?[^#]*)?', 1) END"""
    tag = r"""(?is)<(?:link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*|meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*)>"""
    link = r"""regexp_extract(tag, '(?is)(?:\bhref\s*=\s*["'']?|\burl\s*=\s*["'']?)([^"''>\s]+)', 1)"""
    full = f"""CASE WHEN regexp_matches(target, '^[A-Za-z][\\w+.-]*://') THEN target WHEN starts_with(target, '//') THEN scheme || ':' || target
      WHEN starts_with(target, '/') THEN scheme || '://' || host || target
      ELSE scheme || '://' || host || coalesce(nullif(regexp_replace(path, '[^/]*$', ''), ''), '/') || target END"""
    fill = lambda x: node.replace("{}", x)
    return rf"""
    WITH RECURSIVE p AS (
      SELECT page_id, {host.format("url")} AS host, {path.format("url")} AS path, {fill("url")} AS node, regexp_extract(url, '^([A-Za-z][\w+.-]*):', 1) AS scheme,
        regexp_extract_all(html, '{tag}') AS tags FROM pages),
    judged AS (SELECT *, CASE {" ".join(rules)} END AS fit FROM p),
    targets AS (SELECT node, host, path, scheme, {link} AS target FROM (SELECT *, unnest(tags) AS tag FROM p)),
    links AS (SELECT DISTINCT node AS u, {fill("(" + full + ")")} AS v FROM targets WHERE target <> ''),
    edges AS (SELECT u, v FROM links WHERE u IS NOT NULL AND v IS NOT NULL UNION SELECT v, u FROM links WHERE u IS NOT NULL AND v IS NOT NULL),
    reach(start, node) AS (SELECT DISTINCT node, node FROM judged WHERE node IS NOT NULL AND fit.verdict = 'block'
      UNION SELECT reach.start, edges.v FROM reach JOIN edges ON reach.node = edges.u),
    bad AS (SELECT DISTINCT node FROM reach)
    SELECT page_id, host, path, fit.rule AS rule,
      coalesce(fit.verdict, CASE WHEN node IN (SELECT node FROM bad) THEN 'block' ELSE 'allow' END) AS verdict FROM judged
    """


def op11_sql() -> str:
    p = lambda n, mass: f"(1 + ({divergence.UNIT}::HUGEINT * ({n} + 2)) // ({mass}))::BIGINT"
    f = "((p - q) * (p - q)) // (p + q)"
    return rf"""
    WITH d AS (
      SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{divergence.TERM}') AS w FROM documents),
    kept AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(w)) AS term FROM d) GROUP BY ALL HAVING count(*) >= {divergence.LEAST_DOCS}),
    uses AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(w) AS term FROM d) JOIN kept USING (lang, term) GROUP BY ALL),
    totals AS (SELECT lang, term, sum(n) AS n FROM uses GROUP BY ALL),
    langs AS (SELECT lang, count(*) AS v, sum(n) AS held FROM totals GROUP BY ALL),
    groups AS (
      SELECT g.lang, g.source, coalesce(v, 0) AS v, coalesce(sum(n), 0) + 2 * coalesce(v, 0) AS mass, coalesce(held, 0) + 2 * coalesce(v, 0) AS lang_mass
      FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN langs USING (lang) LEFT JOIN uses USING (lang, source) GROUP BY g.lang, g.source, v, held),
    shares AS (
      SELECT g.lang, g.source, k.term, coalesce(u.n, 0) AS n, {p("coalesce(u.n, 0)", "g.mass")} AS p, {p("t.n", "g.lang_mass")} AS q
      FROM groups g JOIN kept k USING (lang) JOIN totals t USING (lang, term) LEFT JOIN uses u ON (u.lang, u.source, u.term) = (g.lang, g.source, k.term)),
    pairs AS (
      SELECT g.lang, g.source, h.source AS item, coalesce((SELECT sum({f}) FROM (
        SELECT a.p AS p, b.p AS q FROM shares a JOIN shares b USING (lang, term) WHERE a.lang = g.lang AND a.source = g.source AND b.source = h.source)), 0) AS value
      FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source),
    terms AS (SELECT lang, source, term AS item, {f} AS value FROM shares WHERE n > 0 AND p > q),
    parts AS (SELECT *, 'pair' AS part FROM pairs UNION ALL SELECT *, 'term' AS part FROM terms),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
    SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= {divergence.TOP}
    """


def op12_sql() -> str:
    h = hard_negatives
    return f"""
    WITH r AS (
      SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({h.SCALE} * x::DOUBLE)) AS v
      FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scores AS (
      SELECT a.vec_id AS anchor_id, r.vec_id, r.label = a.label AS same, list_inner_product(a.v, r.v)::BIGINT AS score
      FROM r a JOIN r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
    positives AS (
      SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {h.K}),
    ranked AS (
      SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
      FROM positives p JOIN scores s USING (anchor_id) WHERE NOT s.same AND {h.LOW} * positive_score <= 100 * s.score AND 100 * s.score <= {h.HIGH} * positive_score)
    SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= {h.K}
    """
