"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from triplicate.llm.alignment import op13_alignment
from triplicate.llm.bpe import op4_bpe_segment_tree
from triplicate.llm.inner_products import op7_inner_products
from triplicate.llm.nearest import op2_nearest
from triplicate.llm.packing import op8_best_fit_packing
from triplicate.llm.pii import op1_pii
from triplicate.llm.secrets import op3_secrets
from triplicate.llm.simhash import op5_simhash
from triplicate.llm.spelling import op11_spelling_variants
from triplicate.llm.substrings import op9_substring_dedup
from triplicate.llm.token_counts import op12_token_counts
from triplicate.llm.token_files import op6_token_files
from triplicate.llm.toxicity import op10_toxicity

_ALL = (
    op1_pii,
    op2_nearest,
    op3_secrets,
    op4_bpe_segment_tree,
    op5_simhash,
    op6_token_files,
    op7_inner_products,
    op8_best_fit_packing,
    op9_substring_dedup,
    op10_toxicity,
    op11_spelling_variants,
    op12_token_counts,
    op13_alignment,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


#: Windows of 13 words by lists, and integer products; the others need a tokenizer, a hash or a model that SQL lacks.
SQL = {
    "op7_inner_products": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
          WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 10""",
    "op9_substring_dedup": """
        WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
        g AS (SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS key FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM w)),
        m AS (SELECT key, min(doc_id) AS least FROM g GROUP BY key),
        c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM g JOIN m USING (key) WHERE least < doc_id),
        l AS (SELECT doc_id, list(j) AS gone FROM c GROUP BY doc_id)
        SELECT doc_id, len(words) AS n_words, coalesce(len(gone), 0) AS n_removed,
          sha256(coalesce(array_to_string(list_filter(words, lambda x, i: gone IS NULL OR NOT list_contains(gone, i)), ' '), '')) AS kept_sha256
        FROM w LEFT JOIN l USING (doc_id)""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
