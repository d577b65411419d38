"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from assayer.llm import (bpe, chat, decontam, gru, notices, packing, periodic, quality, simhash, tokencount, topk, urls,
                         whitening)
from assayer.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The vocabulary and the pattern that the byte-level queries use.
MULTI_RANKS = "byte_bpe_multi_50k.tiktoken"
PACK_RANKS = "byte_bpe_50k.tiktoken"


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_chat_snapshots(spark, sf):
    """Maximal conversations, rendered."""
    return chat.render(table(spark, sf, "conversations"))


SQL["op1_chat_snapshots"] = chat.SQL


@query
def op2_url_equivalence(spark, sf):
    """Verdict on every page."""
    return urls.judge(table(spark, sf, "pages"))


SQL["op2_url_equivalence"] = urls.SQL


@query
def op3_best_fit_packing(spark, sf):
    """All documents as rows of a packed id matrix."""
    vocab = bpe.vocabulary(spark, public_tokenizers.path(PACK_RANKS))
    return packing.pack(table(spark, sf, "documents"), vocab)


@query
def op4_simhash(spark, sf):
    """Fingerprint and component of every document."""
    return simhash.report(table(spark, sf, "documents"))


@query
def op5_quality_trees(spark, sf):
    """Quality score of every document."""
    return quality.report(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query
def op6_segment_topk(spark, sf):
    """The 20 best rows by inner product for every 20th vector."""
    return topk.top_k(table(spark, sf, "embeddings"))


SQL["op6_segment_topk"] = topk.SQL


@query
def op7_wu_manber(spark, sf):
    """Benchmark windows found in every document."""
    return decontam.report(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


SQL["op7_wu_manber"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
           FROM documents),
     b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
     p AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s
           FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
                 FROM (SELECT item_id, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0))),
     g AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS s
           FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i
                 FROM d, (SELECT DISTINCT n FROM p) WHERE len(w) >= n)),
     m AS (SELECT r, i, g.n, item_id FROM g JOIN p ON g.n = p.n AND g.s = p.s),
     h AS (SELECT r, count(DISTINCT k) AS n_hit
           FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS k FROM m) GROUP BY r),
     t AS (SELECT r, count(DISTINCT item_id) AS n_items,
             string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM m GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""


@query
def op8_gru(spark, sf):
    """Log-probability of every document."""
    return gru.report(table(spark, sf, "documents"))


@query
def op9_trie_counts(spark, sf):
    """Tokens of every document under the unigram model."""
    vocab = bpe.vocabulary(spark, public_tokenizers.path(MULTI_RANKS))
    return tokencount.count_tokens(table(spark, sf, "documents"), vocab, public_tokenizers.PATTERN)


@query
def op10_bpe_transducer(spark, sf):
    """Ids and decoded text of every document, as digests."""
    vocab = bpe.vocabulary(spark, public_tokenizers.path(MULTI_RANKS))
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return bpe.digests(bpe.round_trip(docs, vocab, public_tokenizers.PATTERN))


@query
def op11_fuzzy_notices(spark, sf):
    """Licence notices in every document."""
    return notices.report(table(spark, sf, "documents"))


@query
def op12_periodic_runs(spark, sf):
    """Periodic runs of words in every document."""
    return periodic.report(table(spark, sf, "documents"))


@query
def op13_weighted_whitening(spark, sf):
    """Whitened components of every vector."""
    return whitening.report(table(spark, sf, "embeddings"))
