"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import filter_audit, html_text, jaccard, langid, mixing, pieces, quality_cnn, rules, sharding, telephony, urls, vector_codes, word_bpe
from .common import held_out, table


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as piece ids, with digests of ids and of what they decode to."""
    return pieces.encode_texts(table(spark, sf_dir, "documents"), ["doc_id"])


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), urls.rules_frame(spark, urls.RULES), ["page_id"])


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.fit(docs), ["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality_cnn.score_texts(docs, quality_cnn.fit(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= quality_cnn.THRESHOLD).cast("int").alias("predicted"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"), ["page_id", "url"])


def op7_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telephony.store_texts(table(spark, sf_dir, "documents"), ["doc_id"])


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return rules.judge(docs, rules.references(docs), ["doc_id"])


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.schedule(docs, mixing.WEIGHTS)


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_classes(table(spark, sf_dir, "documents"))


def op11_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as ids of merged pairs, with digests of ids and of what they decode to."""
    return word_bpe.encode_texts(table(spark, sf_dir, "documents"), ["doc_id"], pieces.ship(spark, word_bpe.MODEL))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_url_filter, op3_sharding, op4_language_id, op5_quality, op6_html_text, op7_telephony, op8_quality_rules, op9_mixing, op10_jaccard, op11_word_bpe, op12_filter_audit, op13_vector_codes)}

_URL_RULES = ", ".join(f"('{r}', '{v}')" for r, v in urls.RULES)
_WEIGHTS = ", ".join(f"('{s}', {w})" for s, w in mixing.WEIGHTS.items())

_WHITE = r"[\x20\x09-\x0D]"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _lower(t: str) -> str:
    return f"translate({t}, '{_UPPER}', '{_UPPER.lower()}')"


def _words(t: str) -> str:
    return f"list_filter(string_split_regex({t}, '{_WHITE}+'), lambda x: x <> '')"


#: Characters of the first seven classes of rules.py, in order; the eighth is all beyond ASCII.
_CLASSES = ["a-z", "A-Z", "0-9", r"\x20\x09-\x0D", r"\x22\x27-\x29\x2C-\x2E\x3A\x3B\x3F", r"\x21\x23-\x26\x2A\x2B\x2F\x3C-\x3E\x40\x5B-\x60\x7B-\x7E", r"\x00-\x08\x0E-\x1F\x7F"]
_COUNTS = ", ".join([*(f"length(regexp_replace(t, '[^{c}]', '', 'g'))" for c in _CLASSES), r"length(regexp_replace(t, '[\x00-\x7F]', '', 'g'))"])
_SUMS = ", ".join(f"sum(cs[{k}]) AS c{k}" for k in range(1, 9))
_ALL = " + ".join(f"t.c{k}" for k in range(1, 9))
_APART = " + ".join(f"CASE WHEN {a} > 0 THEN {a} * log2({a} / ((p + q) / 2)) ELSE 0 END" for a in "pq")
_FAILED = f"(n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words)"

#: The table of slots is made here from the shards' names, by the rule that the operator follows; tests hold it
#: against a plain version.
_OWNERS = ", ".join(map(str, sharding.lookup_table(sharding.SHARDS).tolist()))


def _nearest(book: str) -> str:
    """(rid, p, e, far) of the nearest entry of a codebook to each part."""
    return f"""SELECT rid, p, any_value(x) AS x, min({{'far': far, 'e': e}}) AS best FROM (
  SELECT x.rid, x.p, x.x, b.e, list_sum(list_transform(range(1, len(x.x) + 1), lambda i: (x.x[i] - b.x[i]) * (x.x[i] - b.x[i]))) AS far FROM x JOIN {book} b ON b.p = x.p) GROUP BY rid, p"""


def _means(book: str, found: str) -> str:
    """The codebook after one round."""
    return f"""SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM {book} b LEFT JOIN (
  SELECT p, e, list(v ORDER BY i) AS x FROM (SELECT p, best.e AS e, i, floor(sum(x[i])::DOUBLE / count(*))::BIGINT AS v FROM (SELECT p, best, x, unnest(range(1, len(x) + 1)) AS i FROM {found}) GROUP BY ALL) GROUP BY p, e) m ON m.p = b.p AND m.e = b.e"""


_MASK = " + ".join(f"CASE WHEN {c} THEN {1 << k} ELSE 0 END" for k, c in enumerate((f"len(ws) < {filter_audit.MIN_WORDS}", f"100 * len(list_distinct(ws)) < {filter_audit.MIN_DISTINCT} * len(ws)", f"100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {filter_audit.MAX_UPPER} * length(t)", "regexp_matches(t, '[#$%&*|]')", "d.doc_id > least")))

ORACLES = {
    "op12_filter_audit": f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source::VARCHAR, '') AS part, coalesce(text, '') AS t, {_words("coalesce(text, '')")} AS ws, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, {_MASK} AS m, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n FROM d LEFT JOIN l ON l.doc_id = d.doc_id GROUP BY ALL),
o(filter_order, step, before, bit) AS (SELECT '', 0, 0, 0 UNION ALL SELECT filter_order || f, step + 1, before + bit, b FROM o, (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(f, b) WHERE strpos(filter_order, f) = 0),
s AS (SELECT f.filter_order, o.step, o.before, o.bit FROM o JOIN o f ON f.step = 5 AND starts_with(f.filter_order, o.filter_order) AND o.step > 0),
r AS (SELECT part, filter_order, step, bit, sum(CASE WHEN m & (before | bit) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN m & before = 0 AND m & bit > 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN m & before > 0 AND m & bit > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN m = bit THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN m & before = 0 AND m & bit > 0 AND good THEN n ELSE 0 END) AS good_lost, sum(CASE WHEN m & before = 0 AND m & bit > 0 AND toxic THEN n ELSE 0 END) AS toxic_lost FROM c, s GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r""",
    "op13_vector_codes": f"""
WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label, list_transform(embedding, lambda x: floor({vector_codes.SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT rid, p, v[p * w + 1 : (p + 1) * w] AS x FROM (SELECT rid, v, len(v) // {vector_codes.PARTS} AS w, unnest(range({vector_codes.PARTS})) AS p FROM k)),
b0 AS MATERIALIZED (SELECT p, rid - 1 AS e, x FROM x WHERE rid <= {vector_codes.ENTRIES}),
a0 AS MATERIALIZED ({_nearest("b0")}),
b1 AS MATERIALIZED ({_means("b0", "a0")}),
a1 AS MATERIALIZED ({_nearest("b1")}),
b2 AS MATERIALIZED ({_means("b1", "a1")}),
a2 AS MATERIALIZED ({_nearest("b2")}),
c AS (SELECT rid, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, sum(best.far)::BIGINT AS error FROM a2 GROUP BY rid),
h AS (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY p, e, i)) AS h FROM (SELECT p, e, unnest(x) AS v, unnest(range(len(x))) AS i FROM b2))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h.h AS codebooks_sha256 FROM k JOIN c USING (rid), h""",
    "op3_sharding": f"""
WITH owner AS (SELECT [{_OWNERS}] AS o), d AS (SELECT doc_id, source, n_chars, (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {sharding.TABLE_SIZE})::INT AS slot FROM documents)
SELECT doc_id, source, n_chars, slot, printf('shard-%03d', o[slot + 1]) AS shard FROM d, owner""",
    "op8_quality_rules": f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, CASE WHEN text IS NULL THEN NULL ELSE lang END AS lang FROM documents),
w AS (SELECT *, {_words("t")} AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
b AS (SELECT rid, doc_id, lang, len(ws) AS n_words, length(regexp_replace(t, '{_WHITE}+', '', 'g')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, [{_COUNTS}] AS cs FROM w),
g AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
h AS (SELECT rid, unnest([i, i + 1, i + 2]) AS z FROM (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, g) > 1)),
rep AS (SELECT rid, count(DISTINCT z) AS n FROM h GROUP BY rid),
c AS (SELECT rid, lang, {_lower("x")} AS x, count(*) AS n FROM (SELECT rid, lang, unnest(ws) AS x FROM w) GROUP BY ALL),
total AS (SELECT lang, sum(n_words) AS n, {_SUMS} FROM b WHERE lang IS NOT NULL GROUP BY lang HAVING sum(n_words) > 0),
top AS (SELECT lang, x, n FROM (SELECT lang, x, sum(n) AS n FROM c WHERE lang IS NOT NULL GROUP BY lang, x) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, x) <= {rules.COMMON_WORDS}),
cp AS (SELECT b.rid, t.lang, unnest(list_transform(b.cs, lambda v: v / list_sum(b.cs))) AS p, unnest(list_transform([{_ALL.replace(" + ", ", ")}], lambda v: v::DOUBLE / ({_ALL})::DOUBLE)) AS q FROM b, total t WHERE b.word_chars >= {rules.MIN_CHARS}),
cd AS (SELECT rid, lang, sqrt(greatest(0, sum({_APART}) / 2)) AS d FROM cp GROUP BY rid, lang),
wp AS (SELECT b.rid, t.lang, coalesce(c.n, 0)::DOUBLE / b.n_words AS p, top.n::DOUBLE / t.n::DOUBLE AS q FROM b JOIN total t ON b.n_words >= {rules.MIN_WORDS} JOIN top ON top.lang = t.lang LEFT JOIN c ON c.rid = b.rid AND c.x = top.x),
wr AS (SELECT * FROM wp UNION ALL SELECT rid, lang, greatest(0, 1 - sum(p)), greatest(0, 1 - sum(q)) FROM wp GROUP BY rid, lang),
wd AS (SELECT rid, lang, sqrt(greatest(0, sum({_APART}) / 2)) AS d FROM wr GROUP BY rid, lang),
near AS (SELECT b.*, coalesce(rep.n, 0) AS n_repeat_words, round((SELECT min(d) FROM cd WHERE cd.rid = b.rid), {rules.DIGITS}) AS x, round((SELECT min(d) FROM wd WHERE wd.rid = b.rid), {rules.DIGITS}) AS y FROM b LEFT JOIN rep USING (rid))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  {_FAILED} AS base_failed, NOT {_FAILED} AND coalesce(x, 0) <= {rules.MAX_CLASS_DISTANCE} AND coalesce(y, 0) <= {rules.MAX_WORD_DISTANCE} AS kept, x AS class_distance, y AS word_distance FROM near""",
    "op10_jaccard": f"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS rid, doc_id, {_words(_lower("coalesce(text, '')"))} AS ws FROM documents),
g AS (SELECT DISTINCT rid, hash(unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END)) AS g FROM w),
n AS (SELECT rid, count(*) AS n FROM g GROUP BY rid),
p AS (SELECT a.rid AS x, b.rid AS y, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.rid < b.rid GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.rid = x JOIN n b ON b.rid = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(rid, z) AS (SELECT rid, rid FROM w UNION SELECT r.rid, e.y FROM r JOIN e ON e.x = r.z),
c AS (SELECT r.rid, min(w.doc_id) AS component_id FROM r JOIN w ON w.rid = r.z GROUP BY r.rid)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id FROM w JOIN c USING (rid) LEFT JOIN n USING (rid)""",
    "op2_url_filter": f"""
WITH rules(rule, verdict) AS (VALUES {_URL_RULES}),
r AS (SELECT rule, verdict, split_part(rule, '/', 1) AS h, substr(rule, length(split_part(rule, '/', 1)) + 1) AS p FROM rules),
cut AS (SELECT page_id, CASE WHEN coalesce(strpos(url, '://'), 0) > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id,
  translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
best AS (SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM (SELECT DISTINCT host, path FROM u) d JOIN r ON (d.host = r.h OR ends_with(d.host, '.' || r.h)) AND starts_with(d.path, r.p)
  GROUP BY host, path)
SELECT page_id, u.host, u.path, best.rule, coalesce(best.verdict, 'allow') AS verdict
FROM u LEFT JOIN best ON u.host = best.host AND u.path = best.path""",
    "op9_mixing": f"""
WITH RECURSIVE named(source, weight) AS (VALUES {_WEIGHTS}),
src AS (SELECT d.source, coalesce(n.weight, {mixing.DEFAULT_WEIGHT}) AS a, count(*) AS rows_
  FROM documents d LEFT JOIN named n ON n.source = d.source GROUP BY ALL),
s AS (SELECT row_number() OVER (ORDER BY source) AS i, source, a, (rows_ + {mixing.BLOCK_ROWS - 1}) // {mixing.BLOCK_ROWS} AS blocks, sum(a) OVER () AS q FROM src),
c AS (SELECT list(a ORDER BY i) AS a, any_value(q)::BIGINT AS q, count(*)::BIGINT AS k FROM s),
edf AS (
  SELECT -1::BIGINT AS slot, 0::BIGINT AS pick, list_transform(range(k), lambda x: 0::BIGINT) AS done, a, q, k FROM c
  UNION ALL
  SELECT slot + 1, pick_, list_transform(done, lambda d, i: CASE WHEN i = pick_ THEN d + 1 ELSE d END), a, q, k FROM (
    SELECT slot, done, a, q, k, list_min(list_transform(
      list_filter(range(1, k + 1), lambda i: (done[i] * q) // a[i] <= slot + 1),
      lambda i: -((-(done[i] + 1) * q) // a[i]) * 100000 + i)) % 100000 AS pick_
    FROM (SELECT * FROM edf WHERE slot + 1 < q))
),
slots AS (SELECT pick AS i, slot, row_number() OVER (PARTITION BY pick ORDER BY slot) - 1 AS occ FROM edf WHERE slot >= 0),
numbered AS (SELECT d.doc_id, d.source, row_number() OVER (PARTITION BY d.source ORDER BY md5(d.doc_id::VARCHAR), d.doc_id) - 1 AS r FROM documents d),
placed AS (SELECT n.doc_id, n.source, s.i, s.a, s.q::BIGINT AS q, r // {mixing.BLOCK_ROWS} AS block, r % {mixing.BLOCK_ROWS} AS place_in_block FROM numbered n JOIN s ON s.source = n.source),
due AS (SELECT p.*, (block // a) * q + x.slot AS due FROM placed p JOIN slots x ON x.i = p.i AND x.occ = block % a),
blocks_ AS (SELECT due, row_number() OVER (ORDER BY due) - 1 AS slot FROM (SELECT DISTINCT due FROM due))
SELECT doc_id, source, block::BIGINT AS block, place_in_block::BIGINT AS place_in_block, ((block * q) // a)::BIGINT AS release,
  (((block + 1) * q + a - 1) // a)::BIGINT AS deadline, d.due::BIGINT AS due, b.slot::BIGINT AS slot
FROM due d JOIN blocks_ b ON b.due = d.due""",
}
