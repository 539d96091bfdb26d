"""The queries opN_<name> of the corpus operators, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodeweave.llm import chat, decontaminate, exact_dedup, language, lines, phrases, quality, sentencepiece_bpe, sharding, simhash, spelling, toxicity, warc
from lodeweave.llm.common import table


#: The shard limit of op10's query: small, so that tables of every size split.
SHARD_BYTES = 256 << 10
#: op12's query misspells the runs of a document whose checksums this divides.
NOISE = 31


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    own = spark.sql("SELECT -7L AS conv_id, turn, role, :said AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)", args={"said": said})
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.digests(chat.format_conversations(turns))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predict_languages(table(spark, sf_dir, "documents"))


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(table(spark, sf_dir, "pages"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), limit=SHARD_BYTES)


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_digests(table(spark, sf_dir, "documents"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"), noise=NOISE)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_decontamination, op2_sentencepiece, op3_exact_dedup, op4_chat_format, op5_toxicity, op6_quality, op7_language_id, op8_simhash_dedup, op9_warc, op10_sharding, op11_line_dedup, op12_spelling, op13_collocations)}


OP3_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
w AS (SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM w
"""

OP4_SQL = r"""
WITH own(conv_id, turn, role, text) AS (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT * FROM own),
e AS (SELECT *, replace(replace(replace(replace(text, '\', '\b'), '###', '\h\h\h'), '</turn>', '\l/turn>'), '</part>', '\l/part>') AS coded,
  lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  sum(length(coded) + CASE WHEN before IS NULL THEN 6 + length(role) + 8 WHEN before = role THEN 7 ELSE 6 + length(role) + 8 END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, octet_length(encode(payload)) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to FROM f
"""

OP10_SQL = f"""
WITH r AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n_bytes, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS hash FROM documents),
x AS (SELECT depth, hash >> ({sharding.HASH_BITS} - depth)::INT AS bucket, n_bytes FROM r, range(0, {sharding.HASH_BITS + 1}) AS t(depth)),
s AS (SELECT depth, bucket, sum(n_bytes)::BIGINT AS shard_bytes FROM x GROUP BY ALL),
l AS (SELECT c.* FROM s AS c LEFT JOIN s AS p ON p.depth = c.depth - 1 AND p.bucket = c.bucket >> 1
  WHERE c.shard_bytes <= {SHARD_BYTES} AND (c.depth = 0 OR p.shard_bytes > {SHARD_BYTES}))
SELECT doc_id, n_bytes, CASE WHEN l.depth = 0 THEN '' ELSE lpad(bin(l.bucket), l.depth::INT, '0') END AS shard, l.depth::INT AS depth, l.shard_bytes
FROM r JOIN l ON hash >> ({sharding.HASH_BITS} - l.depth)::INT = l.bucket
"""


OP11_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, r, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS i FROM d),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT coalesce(doc_id::VARCHAR, 'null')) >= 3),
m AS (SELECT k.*, c.key IS NOT NULL AND k.doc_id IS DISTINCT FROM c.last AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY r
"""

#: crc32 by its table of 256 entries; letters above U+00BF become one-byte signs, so that distances count code points.
OP12_SQL = """
WITH t AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
r AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents),
d AS (SELECT id, run, count(*) AS n FROM r WHERE length(run) >= 7 GROUP BY ALL),
h AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, octet_length(encode(id || ':' || run)) + 1),
  lambda i: ('0x' || substr(hex(encode(id || ':' || run)), 2 * i - 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, crc[xor(c & 255, b) + 1])), 4294967295) AS h FROM d, t),
m AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
w AS (SELECT word, sum(n)::BIGINT AS n, length(word) AS size, translate(word, 'ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖ×ØÙÚÛÜÝÞßàáâãäåæçèéêëìíîïðñòóôõö÷øùúûüýþÿ', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789!"#$%&()*+,-./:;<=>?@[]^_{|}') AS code
  FROM m GROUP BY word HAVING length(word) >= 7 AND sum(n) >= 2),
x AS (SELECT w.*, unnest(range(1, size + 1)) AS i FROM w),
v AS (SELECT word, n, size, i, substr(code, 1, i - 1) || substr(code, i + 1) AS rest FROM x),
p AS (SELECT a.word, b.word AS other, b.n AS other_n FROM v AS a JOIN v AS b ON a.i = b.i AND a.rest = b.rest AND a.size = b.size AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM v AS a JOIN w AS b ON a.rest = b.code UNION SELECT b.word, a.word, a.n FROM v AS a JOIN w AS b ON a.rest = b.code),
g AS (SELECT word, count(*) AS n_near, max(other_n) AS top FROM p GROUP BY word),
b AS (SELECT p.word, min(p.other) AS best FROM p JOIN g ON p.word = g.word AND p.other_n = g.top GROUP BY p.word),
f AS (SELECT w.word, w.n, coalesce(g.n_near, 0) AS n_near, CASE WHEN top >= 10 * w.n THEN best END AS form, CASE WHEN top >= 10 * w.n THEN top END AS form_n
  FROM w LEFT JOIN g ON w.word = g.word LEFT JOIN b ON w.word = b.word),
c AS (SELECT word, form AS root FROM f WHERE form IS NOT NULL),
e AS (SELECT c.word, coalesce(c5.root, c4.root, c3.root, c2.root, c1.root, c.root) AS root, c5.root AS deep FROM c LEFT JOIN c AS c1 ON c1.word = c.root LEFT JOIN c AS c2 ON c2.word = c1.root
  LEFT JOIN c AS c3 ON c3.word = c2.root LEFT JOIN c AS c4 ON c4.word = c3.root LEFT JOIN c AS c5 ON c5.word = c4.root)
SELECT f.word, f.form, coalesce(e.root, f.word) AS root, f.n, f.n_near, f.form_n FROM f LEFT JOIN e ON f.word = e.word
"""

OP13_SQL = r"""
WITH RECURSIVE q AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS d, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces FROM documents),
s AS (SELECT lang, list_filter(regexp_split_to_array(unnest(pieces), '[\x20\x09]+'), lambda x: x <> '') AS words FROM q),
g AS (SELECT lang, k, array_to_string(list_slice(words, i, i + k - 1), ' ') AS phrase FROM s, range(1, 6) AS r(k), unnest(range(1, len(words) - k + 2)) AS u(i)),
c AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
t AS (SELECT lang, sum(len(words))::BIGINT AS n FROM s GROUP BY lang),
u AS (SELECT c.*, string_split(phrase, ' ') AS words, unnest(range(1, k)) AS cut FROM c WHERE k > 1),
z AS (SELECT u.lang, u.k, u.phrase, u.a, cut, l.a AS l, r.a AS r, t.n, ((1000::HUGEINT * u.a * t.n) // (l.a::HUGEINT * r.a))::BIGINT AS score FROM u
  JOIN c AS l ON l.lang = u.lang AND l.phrase = array_to_string(list_slice(words, 1, cut), ' ')
  JOIN c AS r ON r.lang = u.lang AND r.phrase = array_to_string(list_slice(words, cut + 1, u.k), ' ') JOIN t ON t.lang = u.lang),
b AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
o AS (SELECT b.* FROM b WHERE NOT EXISTS (SELECT 1 FROM c AS x WHERE x.lang = b.lang AND x.k > b.k AND x.a >= b.a AND contains(' ' || x.phrase || ' ', ' ' || b.phrase || ' ')))
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o) WHERE rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": OP3_SQL, "op4_chat_format": OP4_SQL, "op9_warc": OP9_SQL, "op10_sharding": OP10_SQL, "op11_line_dedup": OP11_SQL, "op12_spelling": OP12_SQL, "op13_collocations": OP13_SQL}
