"""The queries of the thirteen operators over the standard tables; thin, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decision_lists, fuzzy_lines, license_rules, minimax_shards, odd_minhash, pii_surrogates, pivot_vectors, quality_gbt, source_audit, source_mix, spaced_seeds, toxicity, trie_repair
from .common import table


def op1_pivot_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_vectors.links(table(spark, sf_dir, "embeddings"))


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_surrogates.pseudonymise(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minimax_shards.shard(table(spark, sf_dir, "documents"), 24)


def op5_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_rules.licences(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gbt.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix(table(spark, sf_dir, "documents"))


def op8_odd_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return odd_minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fuzzy_lines.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.length("text").alias("chars_left"), F.md5("text").alias("text_md5"))


def op10_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spaced_seeds.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_decision_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decision_lists.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op12_trie_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_repair.audit(trie_repair.damaged(table(spark, sf_dir, "conversations")), dropped="dropped")


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_pivot_vectors, op2_pii_surrogates, op3_toxicity, op4_minimax_shards, op5_license_rules, op6_quality, op7_source_mix, op8_odd_minhash, op9_fuzzy_lines, op10_spaced_seeds, op11_decision_lists, op12_trie_repair, op13_source_audit)
    return {f.__name__: f for f in ops} | {"pipeline": pipeline}


#: op8: connected components over exact shingle sets.
_NEAR = """WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
g AS (SELECT doc_id, unnest(s) AS g FROM s), n AS (SELECT doc_id, len(s) AS n FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM n UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id WHERE r.c < e.b)
SELECT n.doc_id, n.n AS n_shingles, min(r.c) AS component_id, min(r.c) = n.doc_id AS kept FROM n JOIN r ON r.doc_id = n.doc_id GROUP BY n.doc_id, n.n"""


#: op7: the same keys, water level and prefix sums.
_MIX = """WITH d AS (SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) END AS size,
 -ln((CAST(('0x' || substr(md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12)) AS BIGINT)::DOUBLE + 0.5) / 281474976710656.0) / coalesce(0.25 + 0.75 * length(translate(text, '0123456789!#$%&*+<=>@[]\\^_`{|}~', '')) / greatest(length(text), 1), 0.25) AS key FROM documents),
z AS (SELECT source, sum(size) AS source_size FROM d GROUP BY 1),
k AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM z),
w AS (SELECT *, [5.0, 2.0, 1.0][CAST(rank % 3 AS INT) + 1]::DOUBLE AS weight, source_size * 3.0::DOUBLE AS cap FROM k),
f AS (SELECT *, cap / weight AS full_at FROM w),
v AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY full_at, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY full_at, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS level FROM f),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT level FROM v WHERE level <= full_at ORDER BY full_at, rank LIMIT 1) * weight, cap)) AS target FROM v),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
r AS (SELECT d.*, e.source_size, e.target, e.epochs, target - epochs * source_size AS rest, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target, CAST(CASE WHEN size > 0 THEN epochs + CAST(before + size / 2 <= rest AS INT) ELSE 0 END * size AS BIGINT) AS taken, CAST(CASE WHEN size > 0 THEN epochs + CAST(before + size / 2 <= rest AS INT) ELSE 0 END AS BIGINT) AS copies FROM r"""


#: op13: every kept term against every source, without histograms.
_DIVERGENCE = """WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
o AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*)::HUGEINT AS n FROM o GROUP BY 1, 2 HAVING count(DISTINCT r) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM o JOIN k USING (lang, term) GROUP BY ALL),
l AS (SELECT lang, sum(n)::HUGEINT AS total, count(*)::HUGEINT AS v FROM k GROUP BY 1),
s AS (SELECT g.lang, g.source, coalesce(sum(n), 0)::HUGEINT AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY 1, 2),
p AS (SELECT k.lang, k.term, s.source, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (s.total + l.v) AS p, 1 + 1000000000::HUGEINT * (k.n + 1) // (l.total + l.v) AS q FROM k JOIN l USING (lang) JOIN s USING (lang) LEFT JOIN c USING (lang, source, term)),
e AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(e.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN e ON e.lang = a.lang AND e.source = a.source AND e.item = b.source
 UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q),
y AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM x)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM y WHERE part = 'pair' OR rank <= 200"""


def _repair_sql() -> str:
    """op12: the DP over rows as a recursive query; a state holds (cost, audit, repaired rows)."""
    add = lambda f, c, e, t: f"CASE WHEN {f} IS NULL THEN NULL ELSE {{'c': {f}['c'] + {c}, 'a': {f}['a'] || '{e}', 't': {t.replace('@', f)}}} END"
    best = lambda *x: f"list_min([{', '.join(x)}])"
    put = lambda row: f"list_append(@['t'], {row})"
    free = lambda f: add(f, 3, "I", put("'user:'"))
    keep = lambda f, c: f"CASE WHEN NOT must AND initial = '{c}' THEN {add(f, 'late', 'K', put(chr(39).join(('role || ', ':', ' || text'))))} END"
    turn = lambda f, r: f"CASE WHEN NOT must THEN {add(f, '3 + late', 'R', put(f'{chr(39)}{r}:{chr(39)} || text'))} END"
    gone = lambda f: add(f, 4, "D", "@['t']")
    closed = f"""i, n0 AS f0, n1 AS f1, {best("n2", free("n0"), free("n1"), free("n3"))} AS f2, n3"""
    answer = add("f2", 3, "I", put("'assistant:'"))
    bits = ", ".join(["-1"] * 8)
    return f"""WITH RECURSIVE raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
h AS (SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(1, length(k) + 1), lambda i: [ascii(k[i])::BIGINT, {bits}]))), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::BIGINT) ELSE c // 2 END), 4294967295::BIGINT) % 20 AS how FROM raw),
d AS (SELECT conv_id, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role, CASE how WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN how = 3 THEN [0, 1] ELSE [0] END) AS copy FROM h WHERE how <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS said FROM d),
r AS (SELECT *, said = '' AS blank, said <> '' AND again AS dup, said <> '' AND NOT again AND right(said, 1) NOT IN ('.', '!', '?') AS open, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o),
s AS (SELECT *, blank OR dup AS must, left(role, 1) AS initial, CASE WHEN open THEN 3 ELSE 0 END AS late FROM r),
c AS (SELECT conv_id, count(*) AS n, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate, count(*) FILTER (open) AS truncated, count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM s GROUP BY conv_id),
p(conv_id, i, f0, f1, f2, f3) AS (SELECT conv_id, 0::BIGINT, {{'c': 0, 'a': '', 't': []::VARCHAR[]}}, NULL::STRUCT(c INTEGER, a VARCHAR, t VARCHAR[]), {{'c': 3, 'a': 'I', 't': ['user:']}}, {{'c': 6, 'a': 'II', 't': ['user:', 'assistant:']}} FROM c
 UNION ALL SELECT conv_id, i, f0, f1, f2, {best("n3", answer)} FROM (SELECT conv_id, {closed} FROM (SELECT p.conv_id, s.i,
  {gone("f0")} AS n0, {best(gone("f1"), keep("f0", "s"))} AS n1, {best(gone("f2"), *(g(f, x) for f in ("f0", "f1", "f3") for g, x in ((keep, "u"), (turn, "user"))))} AS n2, {best(gone("f3"), keep("f2", "a"), turn("f2", "assistant"))} AS n3
  FROM p JOIN s ON s.conv_id IS NOT DISTINCT FROM p.conv_id AND s.i = p.i + 1))),
e AS (SELECT c.*, {best("f0", "f3")} AS best FROM p JOIN c ON c.conv_id IS NOT DISTINCT FROM p.conv_id AND c.n = p.i)
SELECT q.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(best['c'], 0) AS BIGINT) AS cost, coalesce(best['a'], '') AS audit, sha256(coalesce(array_to_string(best['t'], chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) q LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM q.conv_id"""


def oracle_sql() -> dict[str, str]:
    """op7, op8, op12, op13: learnt scores, stand-ins by round, decoded lattices and cuts over the order of Spark's hashes have no SQL here."""
    return {"op7_source_mix": _MIX, "op8_odd_minhash": _NEAR, "op12_trie_repair": _repair_sql(), "op13_source_audit": _DIVERGENCE}
