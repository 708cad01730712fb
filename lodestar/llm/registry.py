"""The operators' queries over the synthetic tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _store, byte_cnn, chat_fsm, collocations, ffd_packing, hilbert, lattice_lm, line_dedup, minhash, page_diff, suffix_quality, token_align, tree_bpe, wav_print


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    _store.ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.scored(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_suffix_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_quality.quality_signals(_table(spark, sf_dir, "documents"))


def op3_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_bpe.encoding_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2
    docs = _table(spark, sf_dir, "documents")
    net = byte_cnn.fitted(docs, ~held)
    return byte_cnn.predicted(docs, net).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op5_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.sharded(_table(spark, sf_dir, "documents"))


def op6_chat_fsm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_fsm.chat_digests(chat_fsm.with_probe(_table(spark, sf_dir, "conversations")))


def op7_ffd_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = ffd_packing.token_pieces(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return ffd_packing.packed(_store.written(cut, "pieces"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_page_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_diff.main_text(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op10_wav_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wav_print.media_digests(_table(spark, sf_dir, "documents"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digests(_table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op13_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_align.alignment_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_lattice_lm, op2_suffix_quality, op3_tree_bpe, op4_byte_cnn, op5_hilbert_shards, op6_chat_fsm, op7_ffd_packing, op8_minhash, op9_page_diff, op10_wav_prints, op11_line_dedup, op12_collocations, op13_token_align)}


_CONTROLS = r"<\|im_start\|>|<\|im_end\|>|<\|endoftext\|>|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>"


def _escaped_chars(text: str) -> str:
    doubled = f"replace({text}, '\\', '\\\\')"
    return f"(length({doubled}) + len(regexp_extract_all({doubled}, '{_CONTROLS}')))"


OP6_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS k,
         lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before FROM c
), p AS (
  SELECT conv_id, turn, role, text, k,
         CASE WHEN (k = 0 AND role IN ('system', 'user')) OR (before IN ('system', 'assistant') AND role = 'user') OR (before = 'user' AND role = 'assistant') THEN NULL
              ELSE 'turn ' || k || ': ' || CASE role WHEN '' THEN 'no role' ELSE role END || ' after ' || CASE WHEN coalesce(before, '') = '' THEN 'the start' ELSE before END END AS broken
  FROM o
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY k), '')) AS loss_sha256,
       CAST(sum(24 + {_escaped_chars("role")} + length(role) - length(replace(role, chr(10), '')) + {_escaped_chars("text")}) AS BIGINT) AS formatted_chars,
       coalesce(arg_min(broken, k) FILTER (WHERE broken IS NOT NULL),
                CASE WHEN arg_max(role, k) IN ('user', 'assistant') THEN NULL ELSE 'ends after ' || arg_max(role, k) END) AS problem
FROM p GROUP BY conv_id
"""


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, CAST(len(w) - 3 AS BIGINT)), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w
), e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), links AS (SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs
), reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
), least AS (SELECT x, min(y) AS m FROM reach GROUP BY x)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(m, s.doc_id)) AS component_id,
       s.doc_id = least(s.doc_id, coalesce(m, s.doc_id)) AS kept
FROM s LEFT JOIN least ON s.doc_id = least.x
"""


_TURN = "(CASE ({by}) WHEN 0 THEN ({v}) WHEN 1 THEN (({v}) >> 1) | ((({v}) & 1) << 2) ELSE (({v}) >> 2) | ((({v}) & 3) << 1) END)"

OP5_SQL = f"""
WITH RECURSIVE crc AS MATERIALIZED (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS tab
), bytes AS (
  SELECT doc_id, lang, source, CAST(strlen(coalesce(text, '')) + 16 AS BIGINT) AS size, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS b FROM documents
), keyed AS (
  SELECT doc_id, size, CAST(xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1])), 4294967295) AS BIGINT) AS text_crc32,
         coalesce(lang, '') AS a, coalesce(source, '') AS b,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 4) AS INTEGER) AS h, bin(size) AS bits FROM bytes, crc
), placed AS (
  SELECT *, rank() OVER (ORDER BY a) - 1 AS ra, rank() OVER (ORDER BY b) - 1 AS rb, count(*) OVER () AS n,
         CAST(least(greatest(length(bits) * 2 + CAST(substr(bits, 2, 1) AS INTEGER) - 10, 0), 31) AS INTEGER) AS step FROM keyed
), cells AS (
  SELECT doc_id, size, text_crc32, h, CAST(ra * 32 // n AS INTEGER) AS x, CAST(rb * 32 // n AS INTEGER) AS y,
         CAST((step - min(step) OVER ()) * 32 // (max(step) OVER () - min(step) OVER () + 1) AS INTEGER) AS z FROM placed
), curve AS (
  SELECT DISTINCT x, y, z, 4 AS bit, 0 AS e, 0 AS d, 0 AS curve_index FROM cells
  UNION ALL
  SELECT x, y, z, bit - 1, xor(e, {_TURN.format(by="(2 - d) % 3", v="[0, 0, 0, 3, 3, 6, 6, 5][digit + 1]")}), (d + [0, 1, 1, 2, 2, 1, 1, 0][digit + 1] + 1) % 3, curve_index * 8 + digit
  FROM (SELECT *, [0, 1, 3, 2, 7, 6, 4, 5][{_TURN.format(by="(d + 1) % 3", v="xor(((x >> bit) & 1) + ((y >> bit) & 1) * 2 + ((z >> bit) & 1) * 4, e)")} + 1] AS digit FROM curve WHERE bit >= 0)
), ranked AS (
  SELECT doc_id, size, text_crc32, curve_index, row_number() OVER (ORDER BY curve_index, h, doc_id NULLS FIRST, text_crc32, size) - 1 AS place, count(*) OVER () AS n
  FROM cells JOIN (SELECT * FROM curve WHERE bit = -1) USING (x, y, z)
)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(place * 40 // n AS INTEGER) AS shard, CAST(place - (place * 40 // n * n + 39) // 40 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard, CAST(curve_index AS INTEGER) AS curve_index FROM ranked
"""


OP2_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g8 AS (SELECT doc_id, unnest(range(1, CAST(len(w) - 6 AS BIGINT))) AS i, unnest(list_transform(range(1, CAST(len(w) - 6 AS BIGINT)), lambda i: array_to_string(w[i:i + 7], ' '))) AS g FROM w WHERE len(w) >= 8),
g5 AS (SELECT doc_id, unnest(range(1, CAST(len(w) - 3 AS BIGINT))) AS i, unnest(list_transform(range(1, CAST(len(w) - 3 AS BIGINT)), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM w WHERE len(w) >= 5),
r8 AS (SELECT doc_id, i, g FROM g8 QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
r5 AS (SELECT doc_id, i, g FROM g5 QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
-- Equal windows side by side on a diagonal are one longer repeat.
pairs AS (SELECT a.doc_id, a.i, b.i - a.i AS d FROM r5 a JOIN r5 b ON a.doc_id = b.doc_id AND a.g = b.g AND a.i < b.i),
runs AS (SELECT doc_id, d, i - row_number() OVER (PARTITION BY doc_id, d ORDER BY i) AS k FROM pairs),
long AS (SELECT doc_id, max(n) + 4 AS longest FROM (SELECT doc_id, d, k, count(*) AS n FROM runs GROUP BY ALL) GROUP BY 1),
base AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM r8) GROUP BY 1),
cover AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM r5) GROUP BY 1),
lines AS (SELECT doc_id, sum(n - 1) AS dup FROM (SELECT doc_id, l, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM w) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY 1, 2) GROUP BY 1),
m AS (
  SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(base.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(cover.n, 0) AS BIGINT) AS covered_words, CAST(coalesce(longest, 0) AS BIGINT) AS longest_repeat
  FROM w LEFT JOIN lines ON w.doc_id = lines.doc_id LEFT JOIN base ON w.doc_id = base.doc_id LEFT JOIN cover ON w.doc_id = cover.doc_id LEFT JOIN long ON w.doc_id = long.doc_id
)
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND covered_words <= CAST(0.3 AS DOUBLE) * n_words AND longest_repeat <= greatest(50, CAST(0.2 AS DOUBLE) * n_words) AS kept FROM m
"""

#: For the pages of the synthetic tables, which all mark their article.
OP9_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|$)', 1) AS body FROM pages),
b AS (SELECT page_id, url, list_transform(regexp_split_to_array(replace(body, '<br>', ' '), '</?(?:p|h1)>'), lambda x: trim(regexp_replace(regexp_replace(replace(regexp_replace(x, '<[^>]*(>|$)', '', 'g'), '&quot;', '"'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS l FROM a),
t AS (SELECT page_id, url, array_to_string(list_filter(l, lambda x: x <> ''), chr(10)) AS text FROM b)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM t
"""


OP11_SQL = """
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents
), k AS (SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM l
), often AS (SELECT k FROM k WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(often.k) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE often.k IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN often USING (k) GROUP BY doc_id
"""


OP12_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p WHERE regexp_matches(piece, '[^\x20\x09]')
), total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang
), grams AS (
  SELECT lang, m, unnest(list_transform(range(1, CAST(len(w) - m + 2 AS BIGINT)), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase
  FROM w, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE len(w) >= m
), f AS (SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30
), c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m >= 2
), cuts AS (SELECT lang, phrase, a, w, m, unnest(range(1, m)) AS k FROM c
), scored AS (
  SELECT cuts.lang, cuts.phrase, a, k, x.f AS l, y.f AS r, CAST(CAST(2000000 AS HUGEINT) * a // (x.f + y.f) AS BIGINT) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = array_to_string(w[1:k], ' ') JOIN f y ON y.lang = cuts.lang AND y.phrase = array_to_string(w[k + 1:], ' ')
), worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inner_phrases AS (
  SELECT c.lang, c.a AS longer, array_to_string(w[i:i + n - 1], ' ') AS phrase
  FROM c, (SELECT unnest([2, 3]) AS n), (SELECT unnest([1, 2, 3]) AS i) WHERE n < m AND i + n - 1 <= m
), kept AS (
  SELECT * FROM worst WHERE NOT EXISTS (SELECT 1 FROM inner_phrases i WHERE i.lang = worst.lang AND i.phrase = worst.phrase AND CAST(100 AS HUGEINT) * longer >= CAST(80 AS HUGEINT) * a)
)
SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS BIGINT) AS rank, phrase, a, l, r, n, score
FROM kept JOIN total USING (lang) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op12_collocations": OP12_SQL, "op11_line_dedup": OP11_SQL, "op2_suffix_quality": OP2_SQL, "op9_page_diff": OP9_SQL, "op5_hilbert_shards": OP5_SQL, "op6_chat_fsm": OP6_SQL, "op8_minhash": OP8_SQL}
