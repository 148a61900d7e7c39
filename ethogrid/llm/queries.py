"""The registered query of each operator, and oracle SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ethogrid.session import table

from .additive import nearest
from .chat import link_tools
from .lexical import search
from .licenses import license_scan
from .mixing import mix
from .neardup import near_duplicates
from .pieces import encode_pieces
from .quality import quality_rules
from .repair import repair
from .suffixes import substring_dedup
from .toxicity import toxicity
from .urlfilter import url_filter
from .wordbpe import digests, encode_words


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op5_chat_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_tools(table(spark, sf_dir, "conversations"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


def op10_additive_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode_words(table(spark, sf_dir, "documents")))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_url_filter": op2_url_filter,
    "op3_toxicity": op3_toxicity,
    "op4_mix_sources": op4_mix_sources,
    "op5_chat_tools": op5_chat_tools,
    "op6_license_scan": op6_license_scan,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_quality_rules": op9_quality_rules,
    "op10_additive_search": op10_additive_search,
    "op11_word_bpe": op11_word_bpe,
    "op12_lexical_search": op12_lexical_search,
    "op13_conversation_repair": op13_conversation_repair,
}


def _edit(after: str, cost: int | str, letters: str) -> str:
    """SQL of a way (cost in twelve digits, letters) with edits before it."""
    return f"(lpad(CAST(CAST(left({after}, 12) AS BIGINT) + {cost} AS VARCHAR), 12, '0') || '{letters}' || substr({after}, 13))"


def _row(when: str, after: str, cost: str, letter: str) -> str:
    """SQL of a way that keeps a row, where that may be."""
    return f"CASE WHEN fault NOT IN ('b', 'd') AND {when} THEN {_edit(after, cost, letter)} ELSE '~' END"


#: Where SQL can say what a query returns; the others are tested against brute force.
ORACLE: dict[str, str] = {
    "op4_mix_sources": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
                   (coalesce(doc_id, -1) % 2147483647 * 48271 + 1) % 2147483647 AS once FROM documents
        ), b AS (SELECT *, (xor(once, once >> 13) % 2147483647 * 69621 + 977) % 2147483647 % 1024 AS bin FROM d
        ), placed AS (
            SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY bin, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM b
        ), s AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS ss, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS number FROM d GROUP BY source
        ), w AS (SELECT *, number % 3 + 1 AS weight, 3 * ss AS cap FROM s
        ), f AS (
            SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
                   sum(weight) OVER (ORDER BY cap / weight, number ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after, sum(ss) OVER () AS total FROM w
        ), l AS (SELECT *, CAST(total - before AS DOUBLE) / CAST(after AS DOUBLE) AS level FROM f
        ), t AS (
            SELECT *, CASE WHEN cap <= weight * level THEN CAST(cap AS DOUBLE) ELSE weight * max(CASE WHEN cap > weight * level THEN level END) OVER () END AS target FROM l
        ), q AS (SELECT *, CAST(least(round(target), cap) AS BIGINT) AS quota, CAST(ceil(ss / 256) AS BIGINT) AS blocks FROM t
        ), r AS (SELECT *, CASE WHEN ss > 0 THEN quota // ss ELSE 0 END AS whole FROM q
        ), x AS (SELECT *, quota - whole * ss AS rest, least(CAST(ceil((quota - whole * ss) / 256) AS BIGINT), blocks) AS tail FROM r
        ), g AS (
            SELECT *, whole * blocks + tail AS slots, CASE WHEN tail > 0 THEN rest - (tail - 1) * 256 ELSE 256 END AS cut, greatest(blocks - 1, 1) AS n FROM x
        ), k AS (SELECT *, unnest(range(0, slots)) AS k FROM g
        ), walk AS (
            SELECT number, k, blocks, slots, cut, k // blocks * 1009 + number AS key, CASE WHEN k % blocks = blocks - 1 THEN 1 ELSE n END AS m,
                   CAST(ceil(sqrt(m)) AS BIGINT) AS a, CAST(ceil(m / a) AS BIGINT) AS b, CASE WHEN k % blocks = blocks - 1 THEN 0 ELSE k % blocks END AS v, 0 AS steps FROM k
            UNION ALL
            SELECT number, k, blocks, slots, cut, key, m, a, b, r3 * a + l3 AS v, steps + 1 FROM (
            SELECT *, v % a AS l0, v // a AS r0,
                   (l0 + (((((r0 * 31 + key * 7919 + 1 * 104729) % 2147483647 * 48271 % 2147483647) >> 7) * 69621 + 977) % 2147483647 >> 3)) % a AS l1,
                   (r0 + (((((l1 * 31 + key * 7919 + 2 * 104729) % 2147483647 * 48271 % 2147483647) >> 7) * 69621 + 977) % 2147483647 >> 3)) % b AS r1,
                   (l1 + (((((r1 * 31 + key * 7919 + 3 * 104729) % 2147483647 * 48271 % 2147483647) >> 7) * 69621 + 977) % 2147483647 >> 3)) % a AS l2,
                   (r1 + (((((l2 * 31 + key * 7919 + 4 * 104729) % 2147483647 * 48271 % 2147483647) >> 7) * 69621 + 977) % 2147483647 >> 3)) % b AS r2,
                   (l2 + (((((r2 * 31 + key * 7919 + 5 * 104729) % 2147483647 * 48271 % 2147483647) >> 7) * 69621 + 977) % 2147483647 >> 3)) % a AS l3,
                   (r2 + (((((l3 * 31 + key * 7919 + 6 * 104729) % 2147483647 * 48271 % 2147483647) >> 7) * 69621 + 977) % 2147483647 >> 3)) % b AS r3
            FROM walk WHERE steps = 0 OR v >= m)
        ), slot AS (
            SELECT number, CASE WHEN k % blocks = blocks - 1 THEN blocks - 1 ELSE v END AS block, CASE WHEN k = slots - 1 THEN cut ELSE 256 END AS take FROM walk WHERE steps > 0 AND v < m
        ), piece AS (
            SELECT number, doc_id, start, size, unnest(range(start // 256, (start + size - 1) // 256 + 1)) AS block
            FROM placed p JOIN s ON p.source IS NOT DISTINCT FROM s.source WHERE size > 0
        ), taken AS (
            SELECT number, start, sum(greatest(0, least(least(start + size - piece.block * 256, 256), take) - greatest(start - piece.block * 256, 0))) AS taken
            FROM piece JOIN slot USING (number, block) GROUP BY number, start
        )
        SELECT p.doc_id, p.source, p.size, g.ss AS source_size, g.target, CAST(CASE WHEN p.size > 0 THEN coalesce(taken.taken, 0) ELSE 0 END AS BIGINT) AS taken
        FROM placed p JOIN g ON p.source IS NOT DISTINCT FROM g.source LEFT JOIN taken ON taken.number = g.number AND taken.start = p.start
    """,
    "op10_additive_search": """
        WITH good AS (
            SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        ), norms AS (
            SELECT vec_id, v, sqrt(list_reduce(list_transform(v, lambda x: x * x), lambda s, x: s + x)) AS n FROM good
        ), pairs AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                   list_reduce(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]), lambda s, x: s + x) / (q.n * c.n) AS score
            FROM norms q JOIN norms c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
        )
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM pairs QUALIFY rank <= 5
    """,
    "op12_lexical_search": r"""
        WITH d AS (
            SELECT row_number() OVER () AS row, doc_id,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
        ), g AS (SELECT CAST(count(*) FILTER (len(terms) > 0) AS BIGINT) AS nd, CAST(sum(len(terms)) AS BIGINT) AS nt FROM d
        ), m AS (SELECT row, doc_id, terms, 100 - 50 + ((50 * len(terms) * nd) // greatest(nt, 1)) AS m FROM d, g
        ), o AS (SELECT row, unnest(terms) AS term FROM d
        ), tf AS (SELECT row, term, count(*) AS tf FROM o GROUP BY row, term
        ), w AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * any_value(nd) + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w FROM tf, g GROUP BY term
        ), q AS (
            SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM benchmark WHERE item_id IS NOT NULL
        ), s AS (
            SELECT item_id, row, any_value(doc_id) AS doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
            FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (row) GROUP BY item_id, row
        )
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
        FROM s WHERE score > 0 QUALIFY rank <= 50
    """,
    "op13_conversation_repair": rf"""
        WITH RECURSIVE a AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(ord(c) AS BIGINT)) AS key FROM conversations
        ), b AS (
            SELECT *, xor(list_reduce(key, lambda s, c: list_reduce([0::BIGINT, 1, 2, 3, 4, 5, 6, 7], lambda v, i: xor(v >> 1, 3988292384 * (v & 1)), xor(s, c)), 4294967295::BIGINT), 4294967295) % 20 AS kind FROM a
        ), c AS (
            SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                   CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
            FROM b WHERE kind <> 0
        ), d AS (
            SELECT *, row_number() OVER w AS n, count(*) OVER (PARTITION BY conv_id) AS total, lag(left(role, 1)) OVER w AS before, left(role, 1) AS initial,
                   regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last,
                   row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth
            FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)
        ), e AS (
            SELECT *, CASE WHEN last = '' THEN 'b' WHEN nth > 1 THEN 'd' WHEN last NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault, CASE WHEN last IN ('.', '!', '?') THEN 0 ELSE 5 END AS left_so FROM d
        ), f AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
                   count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM e GROUP BY conv_id
        ), way AS (
            -- least cost (twelve digits) and letters from before row n to the end, by state: start, after s, after u, after a
            SELECT DISTINCT conv_id, total + 1 AS n, '{0:012}' AS w0, '{10:012}II' AS w1, '{5:012}I' AS w2, '{0:012}' AS w3 FROM e
            UNION ALL
            SELECT conv_id, n, least(r0, {_edit("r2", 5, "I")}, {_edit("r3", 10, "II")}), least(r1, {_edit("r2", 5, "I")}, {_edit("r3", 10, "II")}), least(r2, {_edit("r3", 5, "I")}), least(r3, {_edit("r2", 5, "I")}) FROM (
            SELECT way.conv_id, e.n,
                   least({_edit("w0", 2, "D")}, {_row("initial = 's'", "w1", "left_so", "K")}, {_row("initial = 'u'", "w2", "left_so", "K")}, {_row("true", "w2", "left_so + 1", "R")}) AS r0,
                   least({_edit("w1", 2, "D")}, {_row("initial = 'u'", "w2", "left_so", "K")}, {_row("true", "w2", "left_so + 1", "R")}) AS r1,
                   least({_edit("w2", 2, "D")}, {_row("initial = 'a'", "w3", "left_so", "K")}, {_row("true", "w3", "left_so + 1", "R")}) AS r2,
                   least({_edit("w3", 2, "D")}, {_row("initial = 'u'", "w2", "left_so", "K")}, {_row("true", "w2", "left_so + 1", "R")}) AS r3
            FROM way JOIN e ON e.conv_id IS NOT DISTINCT FROM way.conv_id AND e.n = way.n - 1)
        ), best AS (SELECT conv_id, CAST(left(w0, 12) AS BIGINT) AS cost, substr(w0, 13) AS audit FROM way WHERE n = 1
        ), told AS (
            SELECT conv_id, audit, 0 AS done, 1::BIGINT AS n, 0 AS q, CAST([] AS VARCHAR[]) AS lines FROM best
            UNION ALL
            SELECT conv_id, audit, done + 1, CASE WHEN letter = 'I' THEN n ELSE n + 1 END,
                   CASE WHEN letter = 'D' THEN q WHEN letter = 'K' THEN CASE initial WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END WHEN q = 2 THEN 3 ELSE 2 END,
                   CASE WHEN letter = 'D' THEN lines
                        ELSE list_append(lines, CASE WHEN letter = 'K' THEN role WHEN q = 2 THEN 'assistant' ELSE 'user' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END) END FROM (
            SELECT told.*, substr(audit, done + 1, 1) AS letter, e.role, e.text, e.initial
            FROM told LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM told.conv_id AND e.n = told.n WHERE done < length(audit))
        ), said AS (SELECT conv_id, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256 FROM told WHERE done = length(audit)
        ), every AS (SELECT DISTINCT conv_id FROM conversations)
        SELECT every.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
               coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
        FROM every LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM every.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM every.conv_id
        LEFT JOIN said ON said.conv_id IS NOT DISTINCT FROM every.conv_id
    """,
}
