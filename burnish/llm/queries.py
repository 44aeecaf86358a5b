"""One query for each operator over its whole table, and the SQL that must give the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, exact, langid, minhash, phrases, quality, shards, spiece, suffix, target, tokencount, warc
from .common import new_path

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op1_near_dedup(spark, sf_dir):
    return minhash.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "kept")


@query()
def op2_language_id(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "documents"))


#: All strings of 100 bytes with their earliest place; the others mark their bytes. Bytes are pairs of hex digits.
REPEATS = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    n AS (SELECT *, length(h) // 2 AS n FROM d),
    w AS (SELECT doc_id, i, substr(h, 2 * i - 1, 200) AS s FROM (SELECT *, unnest(range(1, n - 98)) AS i FROM n)),
    g AS (SELECT s, min({'d': doc_id, 'i': i}) AS f FROM w GROUP BY s HAVING count(*) > 1),
    r AS (SELECT doc_id, i FROM w JOIN g USING (s) WHERE {'d': doc_id, 'i': i} <> f),
    c AS (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS c FROM r),
    k AS (SELECT *, sum(c) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM c),
    span AS (SELECT doc_id, k, min(i) AS a, max(i) + 99 AS z FROM k GROUP BY doc_id, k),
    before AS (SELECT doc_id, k, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY k), 0) AS y FROM span),
    cut AS (SELECT doc_id, count(*) AS n_spans, CAST(sum(z - a + 1) AS BIGINT) AS n_removed, max(z) AS z,
        string_agg(substr(h, 2 * y + 1, 2 * (a - 1 - y)), '' ORDER BY k) AS kept FROM before JOIN n USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
    sha256(unhex(CASE WHEN z IS NULL THEN h ELSE concat(kept, substr(h, 2 * z + 1)) END)) AS kept_sha256
FROM n LEFT JOIN cut USING (doc_id)"""


@query(REPEATS)
def op3_suffix_dedup(spark, sf_dir):
    return suffix.remove_repeats(table(spark, sf_dir, "documents"))


@query(r"""WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS normal FROM documents),
    g AS (SELECT normal, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY normal)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(normal) AS text_sha256 FROM t JOIN g USING (normal)""")
def op4_exact_dedup(spark, sf_dir):
    return exact.groups(table(spark, sf_dir, "documents"))


@query()
def op5_sentencepiece(spark, sf_dir):
    """Whole texts encoded, and the ids decoded again."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
    ids = spiece.encode(docs, model, drop=("text",)).withColumns(
        {"n_tokens": F.size("token_ids").cast("bigint"), "ids_xxhash64": F.xxhash64("token_ids")})
    texts = spiece.decode(ids, model, drop=("token_ids",)).withColumn("decoded_sha256", F.sha2("decoded", 256))
    return texts.select("doc_id", "n_tokens", "ids_xxhash64", "decoded_sha256",
                        (F.col("decoded_sha256") == F.col("text_sha256")).alias("same_text"))


@query()
def op6_quality(spark, sf_dir):
    return quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op7_sharding(spark, sf_dir):
    return shards.shard(table(spark, sf_dir, "documents"))


@query("""WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
    f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
        CASE WHEN page_id <> first THEN first END AS refers_to FROM p LEFT JOIN f USING (payload_digest)""")
def op8_warc(spark, sf_dir):
    """Pages written as archives to the shared folder and read back."""
    path = new_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    return warc.read(spark, path).select(F.col("page").cast("bigint").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                                         F.col("refers_to").cast("bigint").alias("refers_to"))


@query()
def op9_token_counts(spark, sf_dir):
    """Every document, with a cache that an earlier run has filled with the texts of one language."""
    model, docs, cache = public_tokenizers.path("piece_bpe_32k.model"), table(spark, sf_dir, "documents"), new_path(spark, "token-cache")
    tokencount.count_tokens(docs.filter("lang = 'en'"), model, cache)
    return tokencount.count_tokens(docs, model, cache)


#: The windows of the items, and the runs of as many words in documents that equal one.
DECONTAMINATION = r"""
WITH item AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    sized AS (SELECT item_id, w, least(len(w), 10) AS n FROM item WHERE len(w) > 0),
    win AS (SELECT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM sized)),
    doc AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
    run AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
        FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM doc, (SELECT DISTINCT n FROM sized))),
    found AS (SELECT doc_id, item_id, n, i FROM run JOIN win USING (n, win)),
    hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM found) GROUP BY doc_id),
    listed AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN listed USING (doc_id)"""


@query(DECONTAMINATION)
def op10_decontamination(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.scan(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


#: All runs of one to three words within pieces, and the cuts of the frequent ones in two.
PHRASES = r"""
WITH piece AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM documents),
    gram AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i
        FROM piece, (SELECT unnest([1, 2, 3]) AS k))),
    often AS (SELECT lang, k, phrase, count(*) AS f FROM gram GROUP BY lang, k, phrase),
    total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM often WHERE k = 1 GROUP BY lang),
    cand AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, f AS a FROM often WHERE k > 1 AND f >= 10),
    inside AS (SELECT DISTINCT c.lang, c.phrase FROM cand AS c JOIN (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase
        FROM cand WHERE k = 3) AS b ON c.lang = b.lang AND c.phrase = b.phrase WHERE 100 * b.a >= 50 * c.a),
    cut AS (SELECT lang, phrase, a, c, array_to_string(w[1:c], ' ') AS p, array_to_string(w[c + 1 : k], ' ') AS q
        FROM (SELECT *, unnest(range(1, k)) AS c FROM cand ANTI JOIN inside USING (lang, phrase))),
    rated AS (SELECT cut.lang, cut.phrase, a, c, x.f AS l, y.f AS r,
        CAST(1000000::HUGEINT * a * a // (x.f::HUGEINT * y.f) AS BIGINT) AS score
        FROM cut JOIN often AS x ON cut.lang = x.lang AND p = x.phrase JOIN often AS y ON cut.lang = y.lang AND q = y.phrase),
    best AS (SELECT * FROM rated QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000"""


@query(PHRASES)
def op11_phrases(spark, sf_dir):
    return phrases.mine(table(spark, sf_dir, "documents"))


#: A conversation whose texts hold what templates use as marks.
HOSTILE = [(-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")]


@query(r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL
        (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))),
    e AS (SELECT *, replace(replace(replace(replace(replace(concat(role, text), '\', '\\'), '<turn>', '<\turn>'), '<text>', '<\text>'),
        '</turn>', '<\/turn>'), '<|endoftext|>', '<\|endoftext|>') AS escaped FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(length(escaped) + length('<turn><text></turn>') + 1) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id""")
def op12_chat_formatting(spark, sf_dir):
    """Every conversation rendered, encoded and masked, and read back from that."""
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = said.unionByName(spark.createDataFrame(HOSTILE, "conv_id bigint, turn bigint, role string, text string"))
    return chat.read_back(chat.format_conversations(said, public_tokenizers.path("byte_bpe_50k.json")))


#: Words once each with their CRC-32, bit by bit; then counts, gains, weights and the draw.
TARGET = r"""
WITH doc AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    item AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS x FROM benchmark),
    part AS (SELECT doc_id, unnest(w) AS x FROM doc),
    known AS (SELECT x, hex(encode(x)) AS h FROM (SELECT x FROM part UNION SELECT x FROM item)),
    hashed AS (SELECT x, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(h) // 2),
        lambda i: CAST(concat('0x', h[2 * i + 1 : 2 * i + 2]) AS BIGINT))), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)),
        lambda y, z: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END)), 4294967295) % 10000 AS bucket FROM known),
    raw AS (SELECT bucket, count(*) AS s FROM part JOIN hashed USING (x) GROUP BY bucket),
    aim AS (SELECT bucket, count(*) AS t FROM item JOIN hashed USING (x) GROUP BY bucket),
    gain AS (SELECT bucket, CAST(floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST((SELECT coalesce(sum(s), 0) FROM raw) + 10000 AS DOUBLE)
        / (CAST(s + 1 AS DOUBLE) * CAST((SELECT coalesce(sum(t), 0) FROM aim) + 10000 AS DOUBLE)))) AS BIGINT) AS g FROM raw LEFT JOIN aim USING (bucket)),
    total AS (SELECT doc_id, CAST(sum(g) AS BIGINT) AS weight FROM part JOIN hashed USING (x) JOIN gain USING (bucket) GROUP BY doc_id),
    drawn AS (SELECT doc_id, CAST(concat('0x', sha256(concat('2024:', doc_id))[1:8]) AS BIGINT) AS h FROM documents),
    scored AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(h AS DOUBLE) + 0.5) / 4294967296.0))) AS BIGINT) AS score
        FROM doc LEFT JOIN total USING (doc_id) JOIN drawn USING (doc_id)),
    ranked AS (SELECT *, row_number() OVER (ORDER BY (n_features >= 20) DESC, score DESC, doc_id) AS place FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT 10 * count(*) // 100 FROM scored WHERE n_features >= 20) THEN place END AS rank FROM ranked"""


@query(TARGET)
def op13_target_resampling(spark, sf_dir):
    return target.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
