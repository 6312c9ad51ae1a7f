"""One registered query per operator, with production parameters over the whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from signalloom.llm import collocations, contentsort, conversations, huffman, hyperminhash, lattice, licenses, packing, pivots, quality, suffixes, toxicity, warc
from signalloom.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file on this machine; executors have it at the same place."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_huffman_token_files(spark, folder):
    """Token ids of all documents through Huffman-coded files and back."""
    return huffman.token_file_round_trip(table(spark, folder, "documents"), vocabulary("byte_bpe_50k.json"), end_id=0)


@query
def op2_suffix_dedup(spark, folder):
    """All documents without the bytes of 200-byte strings that also start elsewhere."""
    return suffixes.digests(table(spark, folder, "documents"))


@query
def op3_pivot_top_k(spark, folder):
    """The five largest inner products of every fiftieth vector with all others."""
    return pivots.top_k(table(spark, folder, "embeddings"), k=5, every=50)


ORACLES["op3_pivot_top_k"] = """
WITH v AS (
  SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v AS q JOIN v AS c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""


@query
def op4_sampled_pieces(spark, folder):
    """A sampled segmentation of every document, decoded again."""
    model = vocabulary("piece_bpe_32k.model")
    decoded = lattice.decode(lattice.sample_encode(table(spark, folder, "documents"), model), model)
    return decoded.select("doc_id", "n_pieces", "ids_crc32", F.col("text").eqNullSafe(F.col("decoded")).alias("lossless"))


@query
def op5_min_slack_packing(spark, folder):
    """All documents packed into sequences of at most 4096 ids."""
    return packing.pack_documents(table(spark, folder, "documents"), vocabulary("word_bpe_49k.json"), end_id=2)


@query
def op6_compression_bands(spark, folder):
    """Word, line and compression rules over all documents."""
    return quality.quality(table(spark, folder, "documents"))


@query
def op7_toxicity_chain(spark, folder):
    """Category probabilities and verdict of all documents."""
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op8_license_scan(spark, folder):
    """Blocks with licence wording in all documents, with the template each comes from."""
    return licenses.scan(table(spark, folder, "documents"))


@query
def op9_hyperminhash(spark, folder):
    """Near-duplicate components of all documents."""
    return hyperminhash.near_duplicates(table(spark, folder, "documents"))


@query
def op10_seekable_warc(spark, folder):
    """All pages written to seekable archives and read back."""
    return warc.archive_round_trip(table(spark, folder, "pages"))


ORACLES["op10_seekable_warc"] = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS payload_digest FROM p),
f AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to
FROM f
"""


@query
def op13_content_sort(spark, folder):
    """Exact duplicates of all documents after white space is made alike."""
    return contentsort.exact_duplicates(table(spark, folder, "documents"))


ORACLES["op13_content_sort"] = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""


@query
def op11_cyk_repair(spark, folder):
    """Faults and cheapest repair of every damaged conversation."""
    return conversations.repair_digests(table(spark, folder, "conversations"))


@query
def op12_dynamic_itemsets(spark, folder):
    """The best phrases of two to four words of every language of all documents."""
    return collocations.collocations(table(spark, folder, "documents"), threshold=30, top=2000)


ORACLES["op12_dynamic_itemsets"] = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents WHERE text IS NOT NULL),
pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
words AS (SELECT lang, [w FOR w IN regexp_split_to_array(piece, '[\x20\x09]+') IF w <> ''] AS w FROM pieces),
sizes AS (SELECT lang, w, unnest(range(1, 5)) AS k FROM words),
starts AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM sizes WHERE len(w) >= k),
f AS (SELECT lang, array_to_string(w[i : i + k - 1], ' ') AS phrase, k, count(*) AS n FROM starts GROUP BY ALL),
total AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE n >= 30),
listed AS (SELECT *, string_split(phrase, ' ') AS w FROM c WHERE k > 1),
cuts AS (SELECT *, unnest(range(1, k)) AS cut FROM listed),
scores AS (
  SELECT u.lang, u.phrase, u.k, u.n AS a, cut, x.n AS l, y.n AS r, CAST(CAST(2000000 AS HUGEINT) * u.n // (x.n + y.n) AS BIGINT) AS score
  FROM cuts AS u JOIN c AS x ON x.lang = u.lang AND x.phrase = array_to_string(w[1 : cut], ' ')
  JOIN c AS y ON y.lang = u.lang AND y.phrase = array_to_string(w[cut + 1 :], ' ')
),
best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
parts AS (SELECT lang, k, n, w, unnest(range(2, k)) AS size FROM listed WHERE k > 2),
inner_ AS (SELECT lang, n, size, w, unnest(range(1, k - size + 2)) AS i FROM parts),
around AS (SELECT lang, array_to_string(w[i : i + size - 1], ' ') AS phrase, max(n) AS n FROM inner_ GROUP BY ALL),
kept AS (SELECT b.* FROM best AS b LEFT JOIN around AS o ON o.lang = b.lang AND o.phrase = b.phrase WHERE o.n IS NULL OR 100 * o.n < 80 * b.a)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, encode(k.phrase)) AS rank, k.phrase, a, l, r, t.n, score
FROM kept AS k JOIN total AS t ON t.lang = k.lang
QUALIFY row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, encode(k.phrase)) <= 2000
"""
