"""The fixture views as SQL, for checking every query against DuckDB."""

from __future__ import annotations

from kinmatch.catalog.fixtures import QUERY_COMPANIES
from kinmatch.schemas import FIELD_WEIGHTS, TEXT_FIELDS

# The SQL side states its own patterns.
_MARKUP = [
    "(?is)<!--.*?-->",
    "(?is)<script\\b.*?</script\\s*>",
    "(?is)<style\\b.*?</style\\s*>",
    "(?is)<head\\b.*?</head\\s*>",
    "(?s)<[^>]*>",
]
_ENTITIES = {"nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "#39": "'", "amp": "&"}
_BLOCK_TAGS = "html|body|nav|ul|li|div|article|h1|p|footer"  # those that the pages of the tables have
_FIELDS = ", ".join(f"'{f}'" for f in TEXT_FIELDS)


def _field_vectors(field: str) -> str:
    return f"""
    SELECT company_id || '_' || field_name AS doc_id, *, company_id AS source_url
    FROM (
      SELECT 'https://company' || printf('%05d', vec_id // 6) || '.com' AS company_id,
             {field} AS field_name,
             'label' || label AS text_content,
             CASE WHEN vec_id % 2 = 0 THEN 'field' || label END AS field_text,
             CASE WHEN vec_id = 100 THEN list_transform(embedding::DOUBLE[], lambda x: 0.0::DOUBLE)
                  WHEN vec_id = 200 THEN (embedding::DOUBLE[])[1:0]
                  WHEN vec_id = 300 THEN (embedding::DOUBLE[])[1:63]
                  ELSE embedding::DOUBLE[] END AS embedding,
             vec_id AS seq, label
      FROM embeddings)"""


def cosine(a: str, b: str) -> str:
    zero = "list_sum(list_transform({0}, lambda x: x * x)) = 0"
    return f"""CASE WHEN {a} IS NULL OR {b} IS NULL OR len({a}) <> len({b}) OR len({a}) = 0
             OR {zero.format(a)} OR {zero.format(b)} THEN 0.0::DOUBLE
             ELSE greatest(-1.0::DOUBLE, least(1.0::DOUBLE, list_cosine_similarity({a}, {b}))) END"""


def decoded(text: str) -> str:
    for entity, char in _ENTITIES.items():
        text = f"replace({text}, '&{entity};', '{char.replace(chr(39), chr(39) * 2)}')"
    return text


def page_text(html: str) -> str:
    for pattern in _MARKUP:
        html = f"regexp_replace({html}, '{pattern}', ' ', 'g')"
    return f"trim(regexp_replace({decoded(html)}, '[ \\t\\r\\n]+', ' ', 'g'))"


def _page_main_text() -> str:
    marked = "translate(html, chr(1) || chr(2) || chr(3), '   ')"
    for pattern in _MARKUP[:-1]:
        marked = f"regexp_replace({marked}, '{pattern}', ' ', 'g')"
    for pattern, mark in [(f"</?({_BLOCK_TAGS})\\b[^>]*>", "chr(3)"), ("<a\\b[^>]*>", "chr(1)"), ("</a\\s*>", "chr(2)"), ("<[^>]*>", "' '")]:
        marked = f"regexp_replace({marked}, '(?is){pattern}', {mark}, 'g')"
    # &copy; and &middot; are the other references that these pages hold.
    plain = decoded("replace(replace(translate(raw, chr(1) || chr(2), ''), '&copy;', chr(169)), '&middot;', chr(183))")
    dense = "length(regexp_replace({0}, '[\\x01\\x02 \\t\\r\\n]+', '', 'g'))"
    linked = "array_to_string(regexp_extract_all(raw, '\\x01([^\\x01\\x02]*)', 1), '')"
    return f"""WITH marked AS (SELECT page_id, string_split({marked}, chr(3)) AS parts FROM pages),
        pieces AS (SELECT page_id, unnest(parts) AS raw, generate_subscripts(parts, 1) AS pos FROM marked),
        texts AS (SELECT page_id, pos, trim(regexp_replace({plain}, '[ \\t\\r\\n]+', ' ', 'g')) AS t,
             3 * {dense.format(linked)} <= {dense.format('raw')} AS plain FROM pieces),
        blocks AS (SELECT *, plain AND len(string_split(t, ' ')) >= 12 AS is_long FROM texts WHERE t <> ''),
        seen AS (SELECT *, is_long OR coalesce(lag(is_long) OVER w, false) OR coalesce(lead(is_long) OVER w, false) AS near,
             bool_or(is_long) OVER (PARTITION BY page_id) AS any_long FROM blocks WINDOW w AS (PARTITION BY page_id ORDER BY pos))
        SELECT page_id, string_agg(t, chr(10) ORDER BY pos) AS content, length(string_agg(t, chr(10) ORDER BY pos))::INTEGER AS size
        FROM seen WHERE plain AND (near OR NOT any_long) GROUP BY page_id"""


def _element(tag: str) -> str:
    inner = f"regexp_extract(html, '(?is)<{tag}\\b[^>]*>(.*?)</{tag}\\s*>', 1)"
    return f"nullif({page_text(inner)}, '')"


PAGE_MAIN_TEXT = _page_main_text()

VIEWS: dict[str, tuple[list[str], str]] = {
    "company_vec": (
        [],
        _field_vectors(f"CASE WHEN vec_id % 11 = 5 THEN 'customer_list' ELSE ([{_FIELDS}])[vec_id % 6 + 1] END"),
    ),
    "vec_history": ([], _field_vectors(f"([{_FIELDS}])[vec_id * vec_id % 6 + 1]")),
    "query_profile": (
        ["company_vec"],
        "SELECT company_id AS query_id, field_name, embedding FROM company_vec WHERE company_id IN ("
        + ", ".join(f"'https://company{n:05d}.com'" for n in QUERY_COMPANIES)
        + ")",
    ),
    "weights": (
        [],
        "SELECT * FROM (VALUES "
        + ", ".join(f"('{f}', {w}::DOUBLE)" for f, w in FIELD_WEIGHTS.items())
        + ") AS w(field_name, weight)",
    ),
    "weighted_query": (
        ["query_profile", "weights"],
        "SELECT q.*, w.weight FROM query_profile q JOIN weights w USING (field_name)",
    ),
    "pairs": (
        ["company_vec", "weighted_query"],
        f"""SELECT q.query_id, c.company_id, q.field_name, q.weight,
             coalesce({cosine('v.embedding', 'q.embedding')}, 0.0) AS sim,
             v.company_id IS NOT NULL AS present
      FROM weighted_query q
      CROSS JOIN (SELECT DISTINCT company_id FROM company_vec) c
      LEFT JOIN company_vec v ON v.company_id = c.company_id AND v.field_name = q.field_name""",
    ),
    "scores": (
        ["pairs"],
        "SELECT query_id, company_id, sum(sim * weight) AS total FROM pairs GROUP BY 1, 2",
    ),
    "ranked": (
        ["scores"],
        """SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY total DESC, company_id) AS rank
      FROM scores WHERE company_id <> query_id""",
    ),
    "firsts": (
        ["company_vec"],
        "SELECT company_id, arg_min(embedding, seq) AS first FROM company_vec GROUP BY 1",
    ),
    "distances": (
        ["company_vec", "weighted_query"],
        """SELECT q.query_id, q.field_name, v.company_id, v.embedding AS vec, q.embedding AS qvec,
             list_distance(v.embedding, q.embedding) AS d
      FROM company_vec v JOIN weighted_query q
        ON q.field_name = v.field_name AND len(q.embedding) = len(v.embedding)""",
    ),
    "crm": (
        [],
        """SELECT o_orderkey AS row_no, 'row_' || o_orderkey AS row_id, 'org_' || printf('%05d', o_orderkey) AS org_id,
             c_name AS name,
             CASE o_orderkey % 8 WHEN 0 THEN url WHEN 1 THEN regexp_replace(url, '^https?://', '')
               WHEN 2 THEN upper(url) WHEN 3 THEN chr(160) || ' ' || url || ' ' || chr(9) WHEN 4 THEN ''
               WHEN 6 THEN 'https://' WHEN 7 THEN 'not a url' END AS website,
             strftime(o_orderdate, '%Y-%m-%d') AS date_added,
             o_orderstatus AS status, o_orderpriority AS priority, c_mktsegment AS sector,
             CASE o_orderkey % 5 WHEN 0 THEN 'N/A' WHEN 1 THEN 'null'
               ELSE 'The "A" fund,' || chr(10) || c_name END AS investors
      FROM orders JOIN customer ON o_custkey = c_custkey
      JOIN pages ON page_id = o_orderkey % (SELECT count(*) FROM pages)""",
    ),
    "checked": (
        ["crm"],
        """SELECT *, CASE WHEN website IS NULL OR trim(website, chr(32) || chr(9) || chr(160)) = '' THEN false
               ELSE regexp_extract(CASE WHEN regexp_matches(t, '^https?://') THEN t ELSE 'https://' || t END,
                                   '^https?://([^/?#]*)', 1) <> '' END AS valid
      FROM (SELECT *, lower(trim(website, chr(32) || chr(9) || chr(160))) AS t FROM crm)""",
    ),
    "edges": (
        [],
        """SELECT 'https://company' || printf('%05d', src_no) || '.com' AS src, pos,
             'Company ' || link_no AS name, 'Seen from ' || src_no AS description,
             (pos % 4)::INTEGER AS overlap_score,
             CASE WHEN (src_no + pos) % 10 = 0 THEN NULL
                  ELSE 'https://company' || printf('%05d', link_no) || '.com' END AS link
      FROM (SELECT l_partkey AS src_no, l_orderkey % (SELECT count(*) FROM part) AS link_no,
                   min(l_orderkey * 10 + l_linenumber) AS pos
            FROM lineitem GROUP BY 1, 2)""",
    ),
    "failed": (
        [],
        "SELECT 'https://company' || printf('%05d', p_partkey) || '.com' AS src FROM part WHERE p_partkey % 13 = 7",
    ),
    "profile_doc": (
        [],
        f"""SELECT page_id, company_id, company_description, industry_vertical, product_form, icp,
             links[1] AS job_to_be_done, NULL::VARCHAR AS revenue_model, links AS customer_list
      FROM (SELECT page_id, url AS company_id, {_element('title')} AS company_description,
              CASE WHEN page_id % 9 = 0 THEN '  ' ELSE regexp_extract(html, '<html lang="([^"]*)"', 1) END
                AS industry_vertical,
              {_element('h1')} AS product_form, regexp_extract(url, '^https?://([^/]*)', 1) AS icp,
              list_transform(regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1),
                '<a [^>]*>([^<]*)</a>', 1), lambda x: {decoded('x')}) AS links
            FROM pages)""",
    ),
    "page_capture": (
        [],
        f"""SELECT page_id, url, CASE WHEN page_id % 17 = 0 THEN '' ELSE {page_text('html')} END AS content
      FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY page_id) AS n FROM pages) WHERE n = 1""",
    ),
    "profile_response": (
        [],
        """SELECT doc_id, doc_id % 6 AS kind, CASE doc_id % 6
             WHEN 0 THEN json_object('company_description', text, 'industry_vertical', lang,
               'product_form', CASE WHEN quality = 1 THEN source END, 'customer_list', [lang, source], 'other_key', 1)::VARCHAR
             WHEN 1 THEN '{"company_description": ' || json_object('text', text)::VARCHAR
             WHEN 2 THEN json_object('company_description', text, 'industry_vertical', lang,
               'product_form', CASE WHEN quality = 1 THEN source END, 'icp', n_chars)::VARCHAR
             WHEN 3 THEN '{}'
             WHEN 4 THEN json_object('company_description', text, 'industry_vertical', lang,
               'product_form', CASE WHEN quality = 1 THEN source END, 'customer_list', [doc_id])::VARCHAR
             ELSE to_json([lang, source])::VARCHAR END AS json
      FROM documents LEFT JOIN labels USING (doc_id)""",
    ),
    "profile_valid": (
        ["profile_response"],
        "SELECT * FROM (SELECT *, "
        + "json_valid(json) AND json_type(json) = 'OBJECT' AND "
        + " AND ".join(
            f"coalesce(json_type(json, '$.{f}') IN ('VARCHAR', 'NULL'), true)" for f in TEXT_FIELDS
        )
        + " AND coalesce(json_type(json, '$.customer_list') IN ('ARRAY', 'NULL'), true)"
        + " AND len(list_filter(json_type(json, '$.customer_list[*]'), lambda t: t <> 'VARCHAR')) = 0 AS valid"
        + " FROM (SELECT doc_id, kind, CASE WHEN json_valid(json) THEN json ELSE 'null' END AS json"
        + " FROM profile_response))",
    ),
    "analysis": (
        [],
        """SELECT doc_id, lang, source, text,
             list_transform(range(doc_id % 13), lambda i: {'name': 'Rival ' || (doc_id * 7 + i),
               'description': lang || ' rival', 'overlap_score': (doc_id + i) % 5,
               'link': CASE WHEN (doc_id + i) % 4 <> 0
                 THEN 'https://company' || printf('%05d', doc_id * 7 + i) || '.com' END}) AS competitors,
             list_transform(range(doc_id % 13), lambda i: {'competitor_name': 'Rival ' || (doc_id * 7 + i),
               'feature_parity': (['✓', '✗', '~', '?', 'x'])[(doc_id + i) % 5 + 1],
               'icp_overlap': (['✓', '✗', '~', '?', 'x'])[(doc_id + i + 1) % 5 + 1],
               'gtm_similarity': (['✓', '✗', '~', '?', 'x'])[(doc_id + i + 2) % 5 + 1],
               'pricing_similarity': (['✓', '✗', '~', '?', 'x'])[(doc_id + i + 3) % 5 + 1],
               'notable_edge': source}) AS matrix,
             list_transform(range(doc_id % 3), lambda s: {'segment_name': lang || ' segment ' || s,
               'pain_points': list_transform(range((doc_id + s) % 5), lambda p: 'pain ' || p)}) AS segments,
             list_transform(range(doc_id % 7), lambda i: 'edge ' || i) AS differentiators
      FROM documents""",
    ),
    "analysis_json": (
        ["analysis"],
        """SELECT doc_id, CASE doc_id % 6
             WHEN 0 THEN json_object('search_query_used', 'Analysis of ' || source, 'search_confidence', 'high',
               'comprehensive_analysis', body)::VARCHAR
             WHEN 1 THEN json_object('search_query_used', 'Analysis of ' || source)::VARCHAR || ']'
             WHEN 2 THEN json_object('search_query_used', 'Analysis of ' || source,
               'comprehensive_analysis', json_merge_patch(body, json_object('summary', doc_id)))::VARCHAR
             WHEN 3 THEN json_object('comprehensive_analysis', body)::VARCHAR
             WHEN 4 THEN json_object('search_query_used', 'Analysis of ' || source, 'search_confidence', NULL,
               'comprehensive_analysis', body)::VARCHAR
             ELSE json_object('search_query_used', 'Analysis of ' || source, 'comprehensive_analysis', body)::VARCHAR
             END AS json
      FROM (SELECT *, json_object('summary', text, 'segments', segments, 'market_map', lang || ' → ' || source,
              'features', source, 'differentiators', differentiators, 'competitors', competitors,
              'matrix', matrix, 'positioning_analysis', source) AS body FROM analysis)""",
    ),
    "analysis_valid": (
        ["analysis_json"],
        """SELECT doc_id, json, coalesce(json_type(json, '$.search_query_used') = 'VARCHAR'
             AND json_type(json, '$.comprehensive_analysis.summary') = 'VARCHAR'
             AND json_type(json, '$.comprehensive_analysis.competitors') = 'ARRAY', false) AS valid
      FROM (SELECT doc_id, CASE WHEN json_valid(json) THEN json ELSE 'null' END AS json FROM analysis_json)""",
    ),
    "good_analysis": (
        ["analysis", "analysis_valid"],
        "SELECT * FROM analysis SEMI JOIN (SELECT doc_id FROM analysis_valid WHERE valid) USING (doc_id)",
    ),
    "overlap_json": (
        [],
        """SELECT doc_id, json_merge_patch(json_object(
               'target_customer', json_object('customer_types', CASE WHEN doc_id % 4 <> 1 THEN [lang, source] END,
                 'buyer_personas', []),
               'job_to_be_done', json_object('primary_problem', text, 'key_use_cases', [source],
                 'outcome_delivered', ''),
               'product_substitutability', json_object('customer_comparison_behavior', lang),
               'channel_distribution', json_object('gtm_strategy', source),
               'competitive_positioning', json_object('commonly_compared_to', [lang]),
               'sources', CASE WHEN doc_id % 3 <> 0 THEN [source, lang] END),
             json_merge_patch(
               CASE WHEN doc_id % 6 <> 3 THEN json_object('business_model',
                 CASE WHEN doc_id % 2 = 0 THEN json_object('revenue_model', source) ELSE json('{}') END)
                 ELSE json('{}') END,
               CASE WHEN doc_id % 6 <> 5 THEN json_object('confidence_level', 'medium') ELSE json('{}') END)) AS json
      FROM documents""",
    ),
    "overlap_valid": (
        ["overlap_json"],
        """SELECT doc_id, json, coalesce(json_type(json, '$.business_model') = 'OBJECT'
             AND json_type(json, '$.confidence_level') = 'VARCHAR', false) AS valid FROM overlap_json""",
    ),
    "detail": (
        [],
        """SELECT c_custkey AS rec_no, json_merge_patch(json_merge_patch(json_merge_patch(
             json_object('id', c_custkey),
             CASE WHEN c_custkey % 7 <> 0 THEN json_object('name', c_name) ELSE json('{}') END),
             CASE c_custkey % 5 WHEN 0 THEN json_object('website', json_object('url', site))
               WHEN 1 THEN json_object('website', site) WHEN 4 THEN json_object('website', json_object('rank', 1))
               ELSE json('{}') END),
             json_merge_patch(CASE WHEN c_custkey % 3 = 0 THEN json_object('segment', c_mktsegment) ELSE json('{}') END,
               CASE WHEN c_custkey % 4 = 0 THEN json_object('nation', c_nationkey) ELSE json('{}') END)) AS json
      FROM (SELECT *, 'https://company' || printf('%05d', c_custkey) || '.com' AS site FROM customer)""",
    ),
    "shown_detail": (
        ["detail"],
        """SELECT rec_no, coalesce(json_extract_string(json, '$.name'), 'Unknown Company') AS name,
             CASE json_type(json, '$.website')
               WHEN 'OBJECT' THEN coalesce(json_extract_string(json, '$.website.url'), 'No website found')
               WHEN 'VARCHAR' THEN json_extract_string(json, '$.website') ELSE 'No website found' END AS website
      FROM detail""",
    ),
    "lookup": (
        [],
        """SELECT c_custkey AS pos, c_custkey // 500 AS batch, CASE WHEN c_custkey // 500 % 3 = 1
               THEN 'urn:company:' || c_custkey WHEN c_custkey // 500 % 3 = 2 AND c_custkey % 500 = 250
               THEN 'stray-' || c_custkey ELSE c_custkey::VARCHAR END AS id FROM customer""",
    ),
    "lookup_kinds": (
        ["lookup"],
        """SELECT batch, count(*) AS size, CASE WHEN arg_min(id, pos) LIKE 'urn:%'
             OR NOT bool_and(regexp_matches(id, '^[0-9]+$')) THEN 'urns' ELSE 'ids' END AS kind
      FROM lookup GROUP BY 1""",
    ),
}


LABELLED_PROFILES = """SELECT company_id AS query_id, field_name, embedding FROM company_vec
  WHERE len(embedding) > 0 AND company_id IN (SELECT company_id FROM company_vec WHERE label = 1)"""


def site_queries() -> str:
    """Vectors of the companies that a customer's address leads to."""
    return """SELECT company_id AS query_id, field_name, embedding FROM company_vec
      WHERE len(embedding) > 0 AND company_id IN (
        SELECT 'https://company' || printf('%05d', c_custkey) || '.com' FROM customer WHERE c_custkey % 4 <> 3)"""


def with_views(names: str, body: str, recursive: bool = False) -> str:
    """Prefix ``body`` with the named views and the views these need."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in VIEWS[name][0]:
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names.split():
        add(name)
    tables = ",\n  ".join(f"{name} AS ({VIEWS[name][1]})" for name in ordered)
    return f"WITH {'RECURSIVE ' if recursive else ''}{tables}\n{body}"
