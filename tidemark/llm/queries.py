"""The corpus operators' queries and, where SQL can express one, their SQL."""

from tidemark.llm.embedding_dedup import op10_embedding_dedup
from tidemark.llm.language_id import op8_language_id
from tidemark.llm.license_scan import op3_license_scan
from tidemark.llm.ngram_join import op1_ngram_jaccard_join
from tidemark.llm.packing import op9_best_fit_packing
from tidemark.llm.piece_lattice import op7_sentencepiece_n_best
from tidemark.llm.quality_rules import op2_quality_rules
from tidemark.llm.secret_scan import op5_secret_scan
from tidemark.llm.token_files import op6_token_files
from tidemark.llm.toxicity import op4_toxicity

QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_quality_rules": op2_quality_rules,
    "op3_license_scan": op3_license_scan,
    "op4_toxicity": op4_toxicity,
    "op5_secret_scan": op5_secret_scan,
    "op6_token_files": op6_token_files,
    "op7_sentencepiece_n_best": op7_sentencepiece_n_best,
    "op8_language_id": op8_language_id,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_embedding_dedup": op10_embedding_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard_join": r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM d)),
sz AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
ov AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
lk AS (SELECT a, b FROM ov JOIN sz x ON x.doc_id = a JOIN sz y ON y.doc_id = b WHERE 100 * o >= 85 * (x.n + y.n - o)),
e AS (SELECT a, b FROM lk UNION ALL SELECT b, a FROM lk),
reach(node, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.root FROM reach r JOIN e ON e.a = r.node)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM (SELECT node AS doc_id, min(root) AS component_id FROM reach GROUP BY 1) LEFT JOIN sz USING (doc_id)""",
    "op10_embedding_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
lk AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id < b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.9),
e AS (SELECT a, b FROM lk UNION ALL SELECT b, a FROM lk),
reach(node, root) AS (SELECT vec_id, vec_id FROM v UNION SELECT e.b, r.root FROM reach r JOIN e ON e.a = r.node),
c AS (SELECT node AS vec_id, min(root) AS component_id FROM reach GROUP BY 1)
SELECT vec_id, (SELECT count(*) FROM e WHERE e.a = c.vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM c""",
}
