"""DuckDB SQL oracles for the registered queries.

Plain SQL over the given tables: pair self-joins, window functions and
``median`` - the straightforward forms the Spark plans avoid for scale reasons.
The label sets, palettes and language orders are stated here once more, so a
slip in the engine's lists shows up as a mismatch. Shared with the Spark side
are only the character classes, built by rule from Python's Unicode tables, and
the token patterns.
"""

from __future__ import annotations

from ..functions.text import (
    CAPITALISED_RUN_PATTERN,
    CJK_RUN_PATTERN_RE2,
    TOKEN_PATTERN,
    py_whitespace_chars,
    title_invalid_class,
)

# Fixed values, stated independently of ``constants``.
SUPPORTED_LANGS = ["en", "zh", "de", "fr", "es", "it", "nl", "pt", "ja"]
ONTONOTES_LANGS = ["zh", "ja", "en"]
VALID_LABELS_ONTONOTES = ["DATE", "FAC", "GPE", "LOC", "ORG", "WORK_OF_ART", "NORP"]
VALID_LABELS_OTHER = ["LOC", "ORG", "MISC"]
CROSSLANG_ORDER = ["en", "es", "ja", "zh", "fr", "de"]
STANDIN_LABELS_ONTONOTES = [
    "PERSON", "NORP", "FAC", "ORG", "GPE", "LOC",
    "PRODUCT", "EVENT", "WORK_OF_ART", "LAW", "LANGUAGE", "DATE",
]
STANDIN_LABELS_OTHER = ["PER", "LOC", "ORG", "MISC"]

WS = "(" + " || ".join(f"chr({ord(c)})" for c in py_whitespace_chars()) + ")"


def _lst(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def fp(x: str) -> str:
    return f"coalesce(split_part({x}, chr(10), 1), '')"


def hex8(x: str) -> str:
    return f"('0x' || substr(md5({x}), 1, 8))::BIGINT"


CORPUS = f"""corpus AS (
  SELECT lang, CAST(doc_id AS BIGINT) AS idx,
         regexp_replace(regexp_extract({fp('text')}, '^ *([^ ]+)', 1), '[.,;:!?]+$', '') AS title,
         text
  FROM documents)"""

VECTORS = """vectors AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings)"""

MEMBERS = """members AS (
  SELECT c.lang, v.label AS cluster_id, c.idx, c.title, v.vec
  FROM corpus c JOIN vectors v ON c.idx = v.vec_id)"""

_ONTO = _in(ONTONOTES_LANGS)

NER = f"""nb AS (
  SELECT lang, idx, title, {strip(fp('text'))} AS ner_text FROM corpus
  WHERE title IS NOT NULL AND {strip('title')} <> '' AND {strip(fp('text'))} <> ''),
ents AS (
  SELECT lang, idx, title,
    list_transform(
      CASE WHEN lang IN ('zh', 'ja') THEN regexp_extract_all(ner_text, '{CJK_RUN_PATTERN_RE2}')
           ELSE regexp_extract_all(ner_text, '{CAPITALISED_RUN_PATTERN}') END,
      lambda s: {{'text': {strip('s')},
                 'label': CASE WHEN lang IN {_ONTO}
                   THEN {_lst(STANDIN_LABELS_ONTONOTES)}[1 + ({hex8('s')} % {len(STANDIN_LABELS_ONTONOTES)})]
                   ELSE {_lst(STANDIN_LABELS_OTHER)}[1 + ({hex8('s')} % {len(STANDIN_LABELS_OTHER)})] END}}) AS entities
  FROM nb),
ner AS (
  SELECT lang AS lang_code, idx AS "index", title, entities,
    NOT regexp_matches(title, '{title_invalid_class()}') AS title_valid,
    len(list_filter(entities, lambda e: length(e.text) > 0
        AND list_contains(CASE WHEN lang IN {_ONTO} THEN {_lst(VALID_LABELS_ONTONOTES)} ELSE {_lst(VALID_LABELS_OTHER)} END, e.label)
        AND (contains(title, e.text) OR contains(e.text, title)))) > 0 AS overlap
  FROM ents),
ner_records AS (
  SELECT lang_code, "index", title, entities, title_valid,
         title_valid AND overlap AS has_overlap,
         title_valid AND overlap AND len(entities) > 0 AS selected
  FROM ner)"""

SELECTED_ARTICLES = f"""selected_articles AS (
  SELECT c.lang, c.idx, c.title, {fp('c.text')} AS first_paragraph
  FROM ner_records r JOIN corpus c ON r.lang_code = c.lang AND r."index" = c.idx
  WHERE r.selected)"""

PARAS = f"""para_lists AS (
  SELECT lang, idx, list_filter(list_transform(string_split(text, chr(10)), lambda x: {strip('x')}), lambda x: x <> '') AS ps
  FROM corpus),
paras AS (
  SELECT lang, idx, unnest(generate_series(0, len(ps) - 1)) AS p, unnest(ps) AS paragraph FROM para_lists)"""


def token_counts(src: str, keys: str, text: str) -> str:
    """Sparse term counts ``(keys, dim, c)`` of the hashing embedder."""
    return f"""SELECT {keys}, {hex8('tok')} % 64 AS dim, CAST(count(*) AS DOUBLE) AS c
    FROM (SELECT {keys}, unnest(regexp_extract_all(lower({text}), '{TOKEN_PATTERN}')) AS tok FROM {src})
    GROUP BY ALL"""


def normalized(tf: str, keys: str) -> str:
    """``c / max(||c||, 1e-12)`` per key.

    Sums run over lists in a fixed order (``list_sum(list(... ORDER BY dim))``)
    so that identical inputs always give bit-identical results; DuckDB's
    parallel aggregation would otherwise add in a varying order.
    """
    return f"""SELECT {keys}, t.dim, t.c / greatest(nm.nrm, 1e-12) AS w
    FROM {tf} t JOIN (SELECT {keys}, sqrt(list_sum(list(c * c ORDER BY dim))) AS nrm FROM {tf} GROUP BY {keys}) nm
    USING ({keys})"""


ENTROPY = f"""{PARAS},
multi AS (SELECT idx, count(*) AS m FROM paras GROUP BY idx HAVING count(*) > 1),
ptf AS ({token_counts('paras JOIN multi USING (idx)', 'idx, p', 'paragraph')}),
pe AS ({normalized('ptf', 'idx, p')}),
pn AS (SELECT idx, p, sqrt(list_sum(list(w * w ORDER BY dim))) AS n2 FROM pe GROUP BY idx, p),
pu AS (SELECT pe.idx, pe.p, pe.dim, pe.w / (pn.n2 + 1e-8) AS u FROM pe JOIN pn USING (idx, p)),
sim AS (
  SELECT a.idx, a.p AS i, b.p AS j, list_sum(list(a.u * b.u ORDER BY a.dim)) AS s
  FROM pu a JOIN pu b ON a.idx = b.idx AND a.dim = b.dim GROUP BY a.idx, a.p, b.p),
rowsum AS (SELECT idx, i, list_sum(list(s ORDER BY j)) AS r, count(*) AS nnz FROM sim GROUP BY idx, i),
prob AS (
  SELECT sim.idx, sim.i, sim.j, least(greatest(s / (r + 1e-8), 1e-8), 1.0) AS q
  FROM sim JOIN rowsum USING (idx, i)),
rows_all AS (
  SELECT paras.idx, paras.p AS i, multi.m FROM paras JOIN multi USING (idx)),
row_terms AS (
  SELECT ra.idx, ra.i, ra.m,
         coalesce(list_sum(list(prob.q ORDER BY prob.j)), 0) + (ra.m - coalesce(any_value(rs.nnz), 0)) * 1e-8 AS z,
         coalesce(list_sum(list(prob.q * ln(prob.q) ORDER BY prob.j)), 0)
           + (ra.m - coalesce(any_value(rs.nnz), 0)) * 1e-8 * ln(1e-8) AS ql
  FROM rows_all ra
  LEFT JOIN rowsum rs ON rs.idx = ra.idx AND rs.i = ra.i
  LEFT JOIN prob ON prob.idx = ra.idx AND prob.i = ra.i
  GROUP BY ra.idx, ra.i, ra.m),
entropy AS (
  SELECT idx, list_sum(list(ln(z) - ql / z ORDER BY i)) / count(*) AS semantic_entropy FROM row_terms GROUP BY idx)"""

QUALITY = f"""{MEMBERS},
m AS (
  SELECT mb.lang, mb.cluster_id, mb.idx, mb.title, mb.vec
  FROM members mb JOIN corpus c ON mb.lang = c.lang AND mb.idx = c.idx
  WHERE {strip('c.text')} <> ''),
sz AS (SELECT lang, cluster_id, count(*) AS group_size FROM m GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.cluster_id, a.idx,
         greatest(0.0, least(2.0, 1.0 - list_cosine_similarity(a.vec, b.vec))) AS d
  FROM m a JOIN m b ON a.lang = b.lang AND a.cluster_id = b.cluster_id),
knn AS (
  SELECT lang, cluster_id, idx, avg(d) AS avg_distance FROM (
    SELECT *, row_number() OVER (PARTITION BY lang, cluster_id, idx ORDER BY d) AS rn FROM pairs)
  WHERE rn <= 5 GROUP BY ALL),
dist AS (
  SELECT k.lang, k.cluster_id, k.idx,
         CASE WHEN s.group_size < 5 THEN 0.0 ELSE k.avg_distance END AS avg_distance, s.group_size
  FROM knn k JOIN sz s USING (lang, cluster_id)),
med AS (SELECT lang, cluster_id, median(avg_distance) AS median_distance FROM dist GROUP BY ALL),
mask AS (
  SELECT d.*, med.median_distance, d.avg_distance <= med.median_distance AS kept,
         1.0 / (d.avg_distance + 1e-8) AS density
  FROM dist d JOIN med USING (lang, cluster_id)),
{ENTROPY},
cand AS (
  SELECT mask.*, m.title, coalesce(entropy.semantic_entropy, 0.0) AS semantic_entropy
  FROM mask JOIN m USING (lang, cluster_id, idx) LEFT JOIN entropy USING (idx)
  WHERE kept),
top AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY lang, cluster_id ORDER BY semantic_entropy DESC, idx) AS rank FROM cand)
  WHERE rank <= 10),
clusters AS (SELECT lang, cluster_id, count(*) AS cluster_size FROM members GROUP BY ALL),
scores AS (
  SELECT c.lang, c.cluster_id, c.cluster_size, t.avg_semantic_entropy, coalesce(t.n_top, 0) AS n_top
  FROM clusters c LEFT JOIN (
    SELECT lang, cluster_id, avg(semantic_entropy) AS avg_semantic_entropy, count(*) AS n_top FROM top GROUP BY ALL
  ) t USING (lang, cluster_id)),
ranked AS (
  SELECT *,
    row_number() OVER (PARTITION BY lang ORDER BY coalesce(avg_semantic_entropy, 0.0) DESC, cluster_id) - 1 AS cluster_rank,
    count(*) OVER (PARTITION BY lang) AS n_clusters
  FROM scores),
ranked_top AS (SELECT *, cluster_rank < floor(n_clusters * 0.2) AS is_top FROM ranked)"""

CLEAN = f"""clean AS (
  SELECT lang AS lang_code, idx, {strip('title')} AS title, {strip(fp('text'))} AS text
  FROM corpus
  WHERE title IS NOT NULL AND length(title) > 0 AND text IS NOT NULL AND length(text) > 0
    AND length({strip(fp('text'))}) >= 10)"""

FIRST_CHAR = f"""{CLEAN},
fc AS (SELECT lang_code, idx, substring(text, 1, 1) AS cluster_id FROM clean),
fc_lang AS (SELECT cluster_id, lang_code, count(*) AS n FROM fc GROUP BY ALL),
fc_dist AS (
  SELECT * FROM (SELECT cluster_id, lang_code, n, sum(n) OVER (PARTITION BY cluster_id) AS sample_count FROM fc_lang)
  WHERE sample_count >= 5)"""

LANG_RANK = (
    "CASE "
    + " ".join(f"WHEN lang_code = '{l}' THEN {i}" for i, l in enumerate(CROSSLANG_ORDER))
    + f" ELSE {len(CROSSLANG_ORDER)} END"
)

DOMINATED = f"""{FIRST_CHAR},
best AS (
  SELECT cluster_id, sample_count, lang_code, n FROM (
    SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, {LANG_RANK}, lang_code DESC) AS rn FROM fc_dist)
  WHERE rn = 1),
dominated AS (
  SELECT cluster_id, CAST(sample_count AS BIGINT) AS sample_count, lang_code AS dominant_lang,
         n / sample_count AS ratio
  FROM best WHERE n / sample_count >= 0.8)"""

VALID_LABEL_ROWS = ", ".join(
    f"('{lang}', '{label}')"
    for lang in SUPPORTED_LANGS
    for label in (VALID_LABELS_ONTONOTES if lang in ONTONOTES_LANGS else VALID_LABELS_OTHER)
)

CENTROIDS = f"""{VECTORS},
cent_long AS (
  SELECT label AS cid, dim, avg(x) AS c FROM (
    SELECT label, unnest(generate_series(1, len(vec))) AS dim, unnest(vec) AS x FROM vectors)
  GROUP BY ALL),
cent AS (SELECT cid, list(c ORDER BY dim) AS cvec FROM cent_long GROUP BY cid),
assign AS (
  SELECT vec_id, vec, cid AS cluster_id, dist FROM (
    SELECT v.vec_id, v.vec, c.cid, list_distance(v.vec, c.cvec) AS dist,
           row_number() OVER (PARTITION BY v.vec_id ORDER BY list_distance(v.vec, c.cvec), c.cid) AS rn
    FROM vectors v CROSS JOIN cent c)
  WHERE rn = 1)"""


KMEANS_COUNTS = """SELECT lang, count(*) AS n, count(DISTINCT idx) AS n_once, least(greatest(2, count(*) // 10), count(*)) AS k,
  count(*) AS size_sum, true AS in_range FROM selected_articles GROUP BY lang"""


def w(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


SQL: dict[str, str] = {
    # sources
    "corpus_scan": w(CORPUS) + "SELECT * FROM corpus",
    "corpus_counts": w(CORPUS) + "SELECT lang, count(*) AS n_rows FROM corpus GROUP BY lang",
    "corpus_slice": w(CORPUS)
    + "SELECT lang, idx, title FROM corpus WHERE idx >= 100 AND idx < 300",
    "slice_counts": w(CORPUS)
    + "SELECT lang, CAST(floor(idx / 100) * 100 AS BIGINT) AS slice_start, count(*) AS n_rows FROM corpus GROUP BY ALL",
    "corpus_cap": w(CORPUS)
    + "SELECT lang, idx, title FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY idx) AS rn FROM corpus) WHERE rn <= 50",
    "jsonl_read": """SELECT lang, source, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS id_sum, 'good' AS reason
    FROM documents WHERE lang IS NULL OR lang NOT IN ('fr', 'es') GROUP BY lang, source
    UNION ALL SELECT '-', '-', count(*), -1, 'not_an_object' FROM documents WHERE lang = 'fr' HAVING count(*) > 0
    UNION ALL SELECT '-', '-', count(*), -1, 'bad_field' FROM documents WHERE lang = 'es' HAVING count(*) > 0""",
    "chunk_merge_order": w(CORPUS)
    + """SELECT lang, idx, chunk_file, row_number() OVER (PARTITION BY lang ORDER BY chunk_file, idx) - 1 AS merge_pos
    FROM (SELECT lang, idx, 'selected_data_' || CAST(CAST(floor(idx / 10) * 10 AS BIGINT) AS VARCHAR) || '.json' AS chunk_file FROM corpus)""",
    # projections / predicates
    "first_paragraph": w(CORPUS) + f"SELECT lang, idx, {fp('text')} AS first_paragraph FROM corpus",
    "title_valid": w(CORPUS)
    + f"SELECT lang, idx, title, NOT regexp_matches(title, '{title_invalid_class()}') AS title_valid FROM corpus",
    "valid_labels": w(CORPUS)
    + f"SELECT l.lang, l.label FROM (SELECT DISTINCT lang FROM corpus) c JOIN (VALUES {VALID_LABEL_ROWS}) l(lang, label) ON c.lang = l.lang",
    "annotate_entities": w(CORPUS, NER)
    + """SELECT lang_code, "index", CAST(ent_pos AS BIGINT) AS ent_pos, e.text AS ent_text, e.label AS ent_label FROM (
      SELECT lang_code, "index", unnest(generate_series(0, len(entities) - 1)) AS ent_pos, unnest(entities) AS e FROM ner_records)""",
    "entity_title_overlap": w(CORPUS, NER) + 'SELECT lang_code, "index", title, title_valid, has_overlap FROM ner_records',
    "ner_selected": w(CORPUS, NER)
    + """SELECT lang_code, "index", title, array_to_string(list_transform(entities, lambda e: e.text || '/' || e.label), '|') AS entities
    FROM ner_records WHERE selected""",
    "ner_filtered": w(CORPUS, NER)
    + """SELECT lang_code, "index", title, array_to_string(list_transform(entities, lambda e: e.text || '/' || e.label), '|') AS entities
    FROM ner_records WHERE NOT selected""",
    "ner_route_counts": w(CORPUS, NER) + "SELECT lang_code, selected, count(*) AS n FROM ner_records GROUP BY ALL",
    "selected_articles": w(CORPUS, NER, SELECTED_ARTICLES) + "SELECT * FROM selected_articles",
    "selected_articles_pos": w(CORPUS, NER)
    + """, sel AS (SELECT lang_code, "index", 0 AS turn FROM ner_records WHERE selected
      UNION ALL SELECT lang_code, "index", 1 FROM ner_records WHERE selected AND lang_code = 'de'),
    placed AS (SELECT lang_code, "index", row_number() OVER (PARTITION BY lang_code ORDER BY turn, "index") - 1 AS pos FROM sel)
    SELECT c.lang, c.idx, p.pos, c.title FROM placed p JOIN corpus c ON c.lang = p.lang_code AND c.idx = p."index" """,
    "embed_prompt": w(CORPUS, NER, SELECTED_ARTICLES)
    + f"SELECT lang, idx, '<title> ' || coalesce({strip('title')}, '') || ' <text> ' || coalesce({strip('first_paragraph')}, '') AS prompt FROM selected_articles",
    "index_out_of_range": w(CORPUS) + "SELECT vec_id * 3 AS idx FROM embeddings WHERE vec_id * 3 NOT IN (SELECT idx FROM corpus)",
    "paragraphs": w(CORPUS, PARAS) + "SELECT lang, idx, CAST(p AS BIGINT) AS p, paragraph FROM paras",
    "clean_articles": w(CORPUS, CLEAN) + "SELECT * FROM clean",
    # embeddings
    "embed_hash": w(CORPUS, NER, SELECTED_ARTICLES)
    + "SELECT lang, idx, dim, c AS weight FROM ("
    + token_counts(
        f"(SELECT lang, idx, '<title> ' || coalesce({strip('title')}, '') || ' <text> ' || coalesce({strip('first_paragraph')}, '') AS prompt FROM selected_articles)",
        "lang, idx",
        "prompt",
    )
    + ")",
    "embed_text_norm": w(CORPUS)
    + "SELECT lang, idx, dim, round(w, 6) AS weight FROM ("
    + normalized("(" + token_counts("corpus", "lang, idx", "text") + ")", "lang, idx")
    + ")",
    "embed_paragraphs": w(CORPUS, PARAS)
    + "SELECT lang, idx, CAST(p AS BIGINT) AS p, dim, round(w, 6) AS weight FROM ("
    + normalized(
        "("
        + token_counts(
            "(SELECT paras.* FROM paras JOIN (SELECT idx FROM paras GROUP BY idx HAVING count(*) > 1) USING (idx))",
            "lang, idx, p",
            "paragraph",
        )
        + ")",
        "lang, idx, p",
    )
    + ")",
    "semantic_entropy": w(CORPUS, ENTROPY)
    + "SELECT c.lang, c.idx, round(coalesce(e.semantic_entropy, 0.0), 6) AS semantic_entropy FROM corpus c LEFT JOIN entropy e USING (idx)",
    # joins / stage 3
    "bucketed_lookups": w(CORPUS, VECTORS, NER, SELECTED_ARTICLES, QUALITY, CLEAN)
    + """SELECT 'selected' AS lookup, lang, idx, title FROM selected_articles
      UNION ALL SELECT 'members', lang, idx, title FROM m
      UNION ALL SELECT 'pooled', clean.lang_code, clean.idx, clean.title FROM clean
        JOIN members mb ON mb.lang = clean.lang_code AND mb.idx = clean.idx WHERE mb.cluster_id < 3""",
    "cluster_members": w(CORPUS, VECTORS, QUALITY) + "SELECT lang, cluster_id, idx, title FROM m",
    "knn_avg_distance": w(CORPUS, VECTORS, QUALITY)
    + "SELECT lang, cluster_id, idx, round(avg_distance, 6) AS avg_distance, group_size FROM dist",
    "knn_neighbours": w(CORPUS, VECTORS, QUALITY)
    + """SELECT lang, cluster_id, idx, nn_rank, nn_id, round(d, 6) AS distance FROM (
      SELECT a.lang, a.cluster_id, a.idx, b.idx AS nn_id,
             greatest(0.0, least(2.0, 1.0 - list_cosine_similarity(a.vec, b.vec))) AS d,
             row_number() OVER (PARTITION BY a.lang, a.cluster_id, a.idx
               ORDER BY greatest(0.0, least(2.0, 1.0 - list_cosine_similarity(a.vec, b.vec))), b.idx) AS nn_rank
      FROM m a JOIN m b ON a.lang = b.lang AND a.cluster_id = b.cluster_id
      JOIN sz ON sz.lang = a.lang AND sz.cluster_id = a.cluster_id
      WHERE sz.group_size >= 5)
    WHERE nn_rank <= 5""",
    "paragraph_similarity": w(CORPUS, ENTROPY)
    + "SELECT p.lang, ra.idx, CAST(ra.i AS BIGINT) AS p, round(coalesce(r.r, 0.0), 6) AS sim_rowsum "
    + "FROM rows_all ra JOIN paras p ON p.idx = ra.idx AND p.p = ra.i "
    + "LEFT JOIN rowsum r ON r.idx = ra.idx AND r.i = ra.i",
    "knn_density": w(CORPUS, VECTORS, QUALITY) + "SELECT lang, cluster_id, idx, round(density, 6) AS density FROM mask",
    "density_mask": w(CORPUS, VECTORS, QUALITY)
    + "SELECT lang, cluster_id, idx, round(median_distance, 6) AS median_distance, kept FROM mask",
    "top_texts": w(CORPUS, VECTORS, QUALITY)
    + """SELECT lang, cluster_id, idx, title, CAST(rank AS BIGINT) AS rank, round(semantic_entropy, 6) AS semantic_entropy,
    round(density, 6) AS density FROM top""",
    "top_density_texts": w(CORPUS, VECTORS, QUALITY)
    + "SELECT lang, cluster_id, count(*) AS n_top, string_agg(title, '|' ORDER BY rank) AS top_titles FROM top GROUP BY ALL",
    "cluster_quality": w(CORPUS, VECTORS, QUALITY)
    + "SELECT lang, cluster_id, cluster_size, CAST(n_top AS BIGINT) AS n_top, round(avg_semantic_entropy, 6) AS avg_semantic_entropy FROM scores",
    "cluster_quality_gaps": w(CORPUS, VECTORS, QUALITY)
    + """, gaps AS (
      SELECT lang, cluster_id, cluster_size, n_top, avg_semantic_entropy FROM scores
      UNION ALL SELECT lang, cluster_id + 1000, cluster_size, 0, NULL FROM clusters
      UNION ALL SELECT lang, cluster_id + 2000, 0, 0, NULL FROM clusters)
    SELECT lang, cluster_id, CAST(cluster_size AS BIGINT) AS cluster_size, CAST(n_top AS BIGINT) AS n_top,
      round(coalesce(avg_semantic_entropy, -1.0), 6) AS avg_semantic_entropy,
      row_number() OVER (PARTITION BY lang ORDER BY coalesce(avg_semantic_entropy, 0.0) DESC, cluster_id) - 1 AS cluster_rank FROM gaps""",
    "knn_blocked": w(VECTORS)
    + """, sz AS (SELECT label, count(*) AS group_size FROM vectors GROUP BY 1),
    pairs AS (SELECT a.label, a.vec_id, greatest(0.0, least(2.0, 1.0 - list_cosine_similarity(a.vec, b.vec))) AS d
      FROM vectors a JOIN vectors b ON a.label = b.label),
    near AS (SELECT label, vec_id, avg(d) AS avg_distance FROM (
      SELECT *, row_number() OVER (PARTITION BY label, vec_id ORDER BY d) AS rn FROM pairs) WHERE rn <= 5 GROUP BY ALL)
    SELECT label AS cluster_id, vec_id AS idx, round(CASE WHEN group_size < 5 THEN 0.0 ELSE avg_distance END, 6) AS avg_distance, group_size
    FROM near JOIN sz USING (label)""",
    "top_clusters": w(CORPUS, VECTORS, QUALITY)
    + """SELECT lang, cluster_id, CAST(cluster_rank AS BIGINT) AS cluster_rank, n_clusters,
    round(avg_semantic_entropy, 6) AS avg_semantic_entropy FROM ranked_top WHERE is_top""",
    "rest_clusters": w(CORPUS, VECTORS, QUALITY)
    + """SELECT lang, cluster_id, CAST(cluster_rank AS BIGINT) AS cluster_rank, n_clusters,
    round(avg_semantic_entropy, 6) AS avg_semantic_entropy FROM ranked_top WHERE NOT is_top""",
    "pool_articles": w(CORPUS, VECTORS, QUALITY, CLEAN)
    + """SELECT clean.*, t.sel_pos FROM clean JOIN (
      SELECT mb.lang, mb.idx, row_number() OVER (PARTITION BY mb.lang ORDER BY r.cluster_rank, mb.idx) - 1 AS sel_pos
      FROM members mb JOIN ranked_top r USING (lang, cluster_id) WHERE r.is_top
    ) t ON clean.lang_code = t.lang AND clean.idx = t.idx""",
    # vectors
    "l2_normalize": w(VECTORS)
    + """SELECT vec_id, CAST(dim AS BIGINT) AS dim, round(x / (sqrt(list_sum(list_transform(vec, lambda y: y * y))) + 1e-8), 6) AS value
    FROM (SELECT vec_id, vec, unnest(generate_series(0, len(vec) - 1)) AS dim, unnest(vec) AS x FROM vectors)""",
    "cosine_distance": w(CENTROIDS)
    + """SELECT v.vec_id, v.label, round(greatest(0.0, least(2.0, 1.0 - list_cosine_similarity(v.vec, c.cvec))), 6) AS distance
    FROM vectors v JOIN cent c ON v.label = c.cid""",
    "standardize": w(VECTORS)
    + """, lng AS (SELECT vec_id, unnest(generate_series(0, len(vec) - 1)) AS dim, unnest(vec) AS x FROM vectors),
    st AS (SELECT dim, avg(x) AS mu, stddev_pop(x) AS sd FROM lng GROUP BY dim)
    SELECT vec_id, CAST(dim AS BIGINT) AS dim, round((x - mu) / CASE WHEN sd = 0 THEN 1.0 ELSE sd END, 6) AS value
    FROM lng JOIN st USING (dim)""",
    "zscore_outliers": w(VECTORS)
    + """, lng AS (SELECT vec_id, unnest(generate_series(0, len(vec) - 1)) AS dim, unnest(vec) AS x FROM vectors),
    st AS (SELECT dim, avg(x) AS mu, stddev_pop(x) AS sd FROM lng GROUP BY dim),
    z AS (SELECT vec_id, max(CASE WHEN sd = 0 THEN 0.0 ELSE abs((x - mu) / sd) END) AS mz FROM lng JOIN st USING (dim) GROUP BY vec_id)
    SELECT vec_id, round(mz, 6) AS max_abs_z, mz <= 3.0 AS kept FROM z""",
    # clustering
    "cluster_count_rule": w(CORPUS, NER, SELECTED_ARTICLES)
    + "SELECT lang, count(*) AS n, least(greatest(2, count(*) // 10), count(*)) AS k FROM selected_articles GROUP BY lang",
    "cluster_assembly": w(CORPUS, NER, SELECTED_ARTICLES)
    + """, arts AS (SELECT s.lang, s.idx, s.title, e.label FROM selected_articles s JOIN embeddings e ON s.idx = e.vec_id),
    ks AS (SELECT lang, count(*) AS n, least(greatest(2, count(*) // 10), count(*)) AS k FROM arts GROUP BY lang),
    lab AS (SELECT a.lang, a.idx, a.title, CAST(a.label % ks.k AS INTEGER) AS cluster_id FROM arts a JOIN ks USING (lang)),
    mem AS (SELECT lang, cluster_id, idx, title,
                   row_number() OVER (PARTITION BY lang, cluster_id ORDER BY idx) - 1 AS member_pos,
                   count(*) OVER (PARTITION BY lang, cluster_id) AS cluster_size FROM lab),
    ids AS (SELECT lang, CAST(unnest(range(k)) AS INTEGER) AS cluster_id FROM ks)
    SELECT ids.lang, ids.cluster_id, CAST(coalesce(mem.cluster_size, 0) AS BIGINT) AS cluster_size,
           CAST(coalesce(mem.member_pos, -1) AS BIGINT) AS member_pos, CAST(coalesce(mem.idx, -1) AS BIGINT) AS idx, mem.title
    FROM ids LEFT JOIN mem USING (lang, cluster_id)""",
    "kmeans_assign_fixed": w(CENTROIDS)
    + "SELECT vec_id, CAST(cluster_id AS BIGINT) AS cluster_id, round(dist, 6) AS centre_distance FROM assign",
    "kmeans_lloyd_step": w(CENTROIDS)
    + """SELECT CAST(cluster_id AS BIGINT) AS cluster_id, CAST(dim AS BIGINT) AS dim, round(avg(x), 6) AS value FROM (
      SELECT cluster_id, unnest(generate_series(0, len(vec) - 1)) AS dim, unnest(vec) AS x FROM assign) GROUP BY ALL""",
    "kmeans_invariants": """SELECT count(*) AS n, count(*) AS n_in_range, CAST(0 AS BIGINT) AS n_off_centre,
      greatest(2, count(DISTINCT embedding) // 10) AS k FROM embeddings""",
    "kmeans_seeding": """SELECT greatest(2, count(DISTINCT embedding) // 10) AS k, greatest(2, count(DISTINCT embedding) // 10) AS n_different,
      true AS no_worse_than_random FROM embeddings""",
    "kmeans_bounds": "SELECT count(*) AS n, CAST(0 AS BIGINT) AS n_other_label, true AS skips_half FROM embeddings",
    "kmeans_tree_cost": """SELECT count(*) AS n, count(DISTINCT vec_id) AS n_once, greatest(2, count(DISTINCT embedding) // 10) AS k,
      true AS near_flat FROM embeddings""",
    "kmeans_single_lang_invariants": w(CORPUS, NER, SELECTED_ARTICLES) + KMEANS_COUNTS,
    "kmeans_two_level_invariants": w(CORPUS, NER, SELECTED_ARTICLES) + KMEANS_COUNTS,
    "kmeans_multi_lang_invariants": w(CORPUS, CLEAN) + "SELECT count(*) AS n, count(*) AS n_once, true AS in_range FROM clean",
    "pca_invariants": "SELECT count(*) AS n, true AS centred, true AS uncorrelated, true AS ordered FROM embeddings",
    # interchange formats
    "json_arrays": w(CORPUS) + "SELECT lang, idx, title, md5(text) AS text_md5 FROM corpus",
    "curated_points": w(CORPUS)
    + """SELECT lang, cluster_id, rank - 1 AS member_pos, title, idx FROM (
      SELECT c.lang, CAST(e.label AS BIGINT) AS cluster_id, c.title, c.idx, row_number() OVER (PARTITION BY c.lang, e.label ORDER BY c.idx) AS rank
      FROM corpus c JOIN embeddings e ON c.idx = e.vec_id) WHERE rank <= 20""",
    # aggregations
    "cluster_sizes": w(CORPUS)
    + "SELECT e.label AS cluster_id, count(*) AS sample_count FROM corpus c JOIN embeddings e ON c.idx = e.vec_id GROUP BY 1",
    "lang_distribution": w(CORPUS)
    + """, pl AS (SELECT e.label AS cluster_id, c.lang AS lang_code, count(*) AS n
             FROM corpus c JOIN embeddings e ON c.idx = e.vec_id GROUP BY ALL)
    SELECT * FROM (SELECT cluster_id, lang_code, n, CAST(sum(n) OVER (PARTITION BY cluster_id) AS BIGINT) AS sample_count FROM pl)
    WHERE sample_count >= 5""",
    "lang_distribution_map": w(CORPUS)
    + """, pl AS (SELECT e.label AS cluster_id, c.lang AS lang_code, count(*) AS n
             FROM corpus c JOIN embeddings e ON c.idx = e.vec_id GROUP BY ALL)
    SELECT cluster_id, CAST(sum(n) AS BIGINT) AS sample_count, string_agg(lang_code || ':' || n, ',' ORDER BY lang_code) AS lang_distribution
    FROM pl GROUP BY cluster_id HAVING sum(n) >= 5""",
    "stage4_records": w(CORPUS, FIRST_CHAR)
    + f""", pos AS (SELECT lang, idx, row_number() OVER (PARTITION BY lang ORDER BY idx) - 1 AS sel_pos FROM corpus),
    full_fc AS (SELECT fc.cluster_id, fc.lang_code, pos.sel_pos, clean.title FROM fc
      JOIN pos ON pos.lang = fc.lang_code AND pos.idx = fc.idx JOIN clean ON clean.lang_code = fc.lang_code AND clean.idx = fc.idx),
    dm AS (SELECT cluster_id, CAST(sample_count AS BIGINT) AS sample_count, string_agg(lang_code || ':' || n, ',' ORDER BY lang_code) AS lang_distribution
      FROM fc_dist GROUP BY cluster_id, sample_count),
    sm AS (SELECT cluster_id, string_agg(lang_code || '/' || sel_pos || '/' || title, '|' ORDER BY lang_code, sel_pos) AS samples FROM full_fc GROUP BY cluster_id)
    SELECT dm.cluster_id, dm.sample_count, dm.lang_distribution, CASE WHEN dm.sample_count <= 60 THEN sm.samples ELSE '-' END AS samples
    FROM dm JOIN sm USING (cluster_id)""",
    "cluster_min_size": w(CORPUS, FIRST_CHAR) + "SELECT DISTINCT cluster_id, CAST(sample_count AS BIGINT) AS sample_count FROM fc_dist",
    "dominant_lang_clusters": w(CORPUS, DOMINATED)
    + "SELECT cluster_id, sample_count, dominant_lang, round(ratio, 6) AS ratio, round_even(ratio, 3) AS dominant_lang_ratio FROM dominated",
    "dominant_lang_counts": w(CORPUS, DOMINATED) + "SELECT dominant_lang, count(*) AS n_clusters FROM dominated GROUP BY 1",
    # reports
    "sample_per_lang": w(CORPUS)
    + """SELECT lang, idx, sample_rank FROM (
      SELECT lang, idx, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || CAST(idx AS VARCHAR)), idx) AS sample_rank FROM corpus)
    WHERE sample_rank <= 50""",
    "lang_share": w(CORPUS)
    + "SELECT lang, n, round(n / sum(n) OVER (), 6) AS share FROM (SELECT lang, count(*) AS n FROM corpus GROUP BY lang)",
    "source_centroids": w(CORPUS, NER)
    + """, tw AS ("""
    + normalized("(" + token_counts("corpus", "lang, idx", "text") + ")", "lang, idx")
    + """),
    flags AS (
      SELECT c.lang, c.idx, coalesce(r.selected, false) AS selected
      FROM corpus c LEFT JOIN ner_records r ON r.lang_code = c.lang AND r."index" = c.idx),
    counts AS (SELECT lang, count(*) AS n_raw, sum(CASE WHEN selected THEN 1 ELSE 0 END) AS n_sel FROM flags GROUP BY lang),
    cent AS (
      SELECT tw.lang, tw.dim,
             sum(tw.w) / any_value(counts.n_raw) AS r,
             sum(CASE WHEN f.selected THEN tw.w ELSE 0 END) / nullif(any_value(counts.n_sel), 0) AS s
      FROM tw JOIN flags f USING (lang, idx) JOIN counts USING (lang) GROUP BY tw.lang, tw.dim),
    sims AS (
      SELECT lang, sum(r * s) / (sqrt(sum(r * r)) * sqrt(sum(s * s))) AS cs FROM cent GROUP BY lang)
    SELECT counts.lang, counts.n_raw, CAST(counts.n_sel AS BIGINT) AS n_selected,
           CASE WHEN counts.n_sel > 0 THEN round(least(greatest(1.0 - sims.cs, 0.0), 2.0), 6) END AS centroid_distance
    FROM counts LEFT JOIN sims USING (lang)""",
    "source_comparison": w(CORPUS, NER)
    + """, a AS (SELECT lang, count(*) AS n FROM corpus GROUP BY lang),
    b AS (SELECT lang_code AS lang, count(*) AS n FROM ner_records WHERE selected GROUP BY 1)
    SELECT coalesce(a.lang, b.lang) AS lang, CAST(coalesce(a.n, 0) AS BIGINT) AS raw_n, CAST(coalesce(b.n, 0) AS BIGINT) AS selected_n,
           round(coalesce(a.n / (SELECT sum(n) FROM a), 0.0), 6) AS raw_share,
           round(coalesce(b.n / (SELECT sum(n) FROM b), 0.0), 6) AS selected_share
    FROM a FULL JOIN b ON a.lang = b.lang""",
}
