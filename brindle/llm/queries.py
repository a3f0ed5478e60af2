"""The registered queries of this package: name -> (callable(spark, folder), SQL or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from brindle.llm import (decontaminate, exact_dedup as dedup, fill_middle, fingerprints, language_id, main_text, mixing, near_dedup, ngram_scores, packing, quality,
                         secret_scan as secrets, spelling)
from brindle.llm.tables import hash_mod, table

# crc32 of an id as text, which the SQL engine lacks: fold its bytes bit by bit.
CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
    string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: [ascii(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END))"""


def op1_ngram_scores(spark: SparkSession, folder: str) -> DataFrame:
    scored = ngram_scores.score_texts(table(spark, folder, "documents"), hash_mod("doc_id", 5) == 1)
    return scored.withColumns({c: F.round(c, 6) for c in ("base_score", "score")})


OP1_SQL = rf"""
WITH docs AS (SELECT doc_id, {CRC} % 5 = 1 AS held_out,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
tokens AS (SELECT doc_id, held_out, unnest(list_append(w, ' ')) AS w, generate_subscripts(list_append(w, ' '), 1) AS i FROM docs),
grams AS (SELECT *, lag(w) OVER d AS v, lag(w, 2) OVER d AS u FROM tokens WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
c1 AS (SELECT w, count(*) AS n FROM grams WHERE NOT held_out GROUP BY ALL),
c2 AS (SELECT v, w, count(*) AS n FROM grams WHERE NOT held_out AND v IS NOT NULL GROUP BY ALL),
c3 AS (SELECT u, v, w, count(*) AS n FROM grams WHERE NOT held_out AND u IS NOT NULL GROUP BY ALL),
size AS (SELECT CAST(sum(n) AS BIGINT) AS total, count(*) AS words FROM c1),
counted AS (
  SELECT doc_id, held_out, total, coalesce(c1.n, 0) AS n1, coalesce(c2.n, 0) AS n2, coalesce(c3.n, 0) AS n3,
         coalesce(h1.n, 0) AS h1, coalesce(h2.n, 0) AS h2, (coalesce(c1.n, 0) + 0.5) / (total + 0.5 * (words + 1)) AS p1
  FROM grams g CROSS JOIN size LEFT JOIN c1 ON c1.w = g.w LEFT JOIN c2 ON c2.v = g.v AND c2.w = g.w
  LEFT JOIN c3 ON c3.u = g.u AND c3.v = g.v AND c3.w = g.w
  LEFT JOIN c1 h1 ON h1.w = g.v LEFT JOIN c2 h2 ON h2.v = g.u AND h2.w = g.v),
two AS (SELECT *, CASE WHEN h1 > 0 THEN (n2 + 4.0 * pow(h1, 0.9) * p1) / (h1 + 4.0 * pow(h1, 0.9)) ELSE p1 END AS p2 FROM counted),
three AS (SELECT *, CASE WHEN h2 > 0 THEN (n3 + 4.0 * pow(h2, 0.9) * p2) / (h2 + 4.0 * pow(h2, 0.9)) ELSE p2 END AS p3 FROM two)
SELECT doc_id, held_out, count(*) AS n_tokens, count(*) FILTER (WHERE n1 > 0) AS n_known, total AS train_tokens,
       round(fsum(log10(p1::DOUBLE)), 6) AS base_score, round(fsum(log10(p3::DOUBLE)), 6) AS score FROM three GROUP BY doc_id, held_out, total
"""


def op2_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(spark, folder, "documents"))


def op3_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.find_secrets(table(spark, folder, "documents"))


def _secrets_sql() -> str:
    def spans(order: int, rule: secrets.Rule) -> str:
        pattern = rule.pattern.replace("'", "''")
        place = "list_sum(gaps[:i]) + coalesce(list_sum(found[:i - 1]), 0)"
        return f"""(SELECT doc_id, {order} AS o, '{rule.kind}' AS kind, {place} AS s, {place} + found[i] AS e FROM (
            SELECT *, unnest(range(1, len(found) + 1)) AS i FROM (SELECT doc_id,
              list_transform(string_split_regex(body, '{pattern}'), lambda x: len(x)) AS gaps,
              list_transform(regexp_extract_all(body, '{pattern}'), lambda x: len(x)) AS found,
              list_transform(regexp_extract_all(body, '{pattern}', {rule.group}), lambda x: len(x)) AS valued FROM docs))
          WHERE valued[i] >= {rule.least})"""

    rules = secrets.BASE_RULES + secrets.MORE_RULES
    counts = ", ".join(f"count(s) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in secrets.BASE_RULES)
    text = "string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, o)"
    return f"""WITH docs AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
      spans AS ({" UNION ALL ".join(spans(i, r) for i, r in enumerate(rules))})
    SELECT d.doc_id, {counts}, sha256(coalesce({text} FILTER (WHERE o < {len(secrets.BASE_RULES)}), '')) AS base_sha256,
           coalesce({text} FILTER (WHERE s IS NOT NULL), '') AS spans
    FROM docs d LEFT JOIN spans USING (doc_id) GROUP BY d.doc_id"""


OP3_SQL = _secrets_sql()


def op4_packing(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    pieces = packing.pack(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_tokens")


def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.score_quality(table(spark, folder, "documents"), table(spark, folder, "labels"), hash_mod("doc_id", 5) == 0)


def op6_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return main_text.extract_main_text(table(spark, folder, "pages"))


def op7_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.exact_dedup(*dedup.split_by_hash(table(spark, folder, "documents")))


OP7_SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS s FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY s) AS keep_id, count(*) OVER (PARTITION BY s) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY s) AS kept, s AS text_sha256 FROM t
"""


def op8_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, folder, "documents"), size=4)


# Exact: every pair of texts that share a shingle; the component is reached along links.
OP8_SQL = r"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
runs AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END)) AS s FROM docs),
sizes AS (SELECT d.doc_id, count(s) AS n FROM docs d LEFT JOIN runs r USING (doc_id) GROUP BY d.doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM runs x JOIN runs y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM docs UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT s.doc_id, n AS n_shingles, min(other) AS component_id, s.doc_id = min(other) AS kept
FROM sizes s JOIN reach r USING (doc_id) GROUP BY s.doc_id, n
"""


def op9_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language_id.identify(table(spark, folder, "documents"), hash_mod("doc_id", 3) == 1)


def op10_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.take_plan(table(spark, folder, "documents")).drop("tie")


OP10_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, md5(concat_ws('#', doc_id, '7')) AS r,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM sized GROUP BY source),
levels AS (
  SELECT 2.0 * source_size / weight AS stop,
         (1.5 * sum(source_size) OVER () - coalesce(sum(2.0 * source_size) OVER before, 0)) / sum(weight) OVER onward AS level
  FROM sources
  WINDOW before AS (ORDER BY 2.0 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         onward AS (ORDER BY 2.0 * source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
chosen AS (SELECT first(level ORDER BY stop) FILTER (WHERE level <= stop) AS level FROM levels),
goals AS (
  SELECT source, source_size, CAST(least(2.0 * source_size, weight * level) AS DOUBLE) AS target FROM sources, chosen),
placed AS (
  SELECT doc_id, size, source_size, target, CAST(floor(target) AS BIGINT) AS budget,
         sum(size) OVER (PARTITION BY s.source ORDER BY r, doc_id) - size AS earlier
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0 ELSE budget // source_size * size
            + greatest(0, least(budget % source_size - earlier, size)) END AS BIGINT) AS taken FROM placed
"""


def op11_fill_middle(spark: SparkSession, folder: str) -> DataFrame:
    made = fill_middle.fill_in_middle(table(spark, folder, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(fill_middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


OP11_SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
    list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), i, 8) AS BIGINT)) AS h FROM documents),
cuts AS (SELECT *, least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS a, greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS b,
    CASE WHEN body = '' OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
         WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM docs),
parts AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM cuts)
SELECT doc_id, len(u) AS n, form, CASE WHEN form <> 'plain' THEN len(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN len(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN body WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(body) AS restored_sha256 FROM parts
"""


def op12_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"), size=10)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


_LEAK_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP12_SQL = rf"""
WITH docs AS (SELECT doc_id, {_LEAK_WORDS} AS w FROM documents),
items AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_LEAK_WORDS} AS w FROM benchmark),
windows AS (SELECT DISTINCT item, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS body
            FROM (SELECT *, least(len(w), 10) AS size FROM items WHERE len(w) > 0)),
runs AS (SELECT doc_id, size, unnest(range(1, len(w) - size + 2)) AS i, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS body
         FROM docs, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size),
found AS (SELECT doc_id, i, r.size, item FROM runs r JOIN windows USING (body)),
hit AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS place FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS items FROM found GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""


def op13_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variant_forms(spelling.vocabulary(table(spark, folder, "documents")))


# crc32 by a table of the 256 byte values, itself folded bit by bit; letters up to U+00FF take two bytes at most.
OP13_SQL = r"""
WITH RECURSIVE crc AS MATERIALIZED (SELECT list(list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY b) AS t
    FROM (SELECT unnest(range(256)) AS b)),
runs AS (SELECT doc_id, run, count(*) AS times FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents) WHERE len(run) >= 7 GROUP BY ALL),
hashed AS (SELECT run, times, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || run, ''),
    lambda ch: CASE WHEN unicode(ch) < 128 THEN [unicode(ch)::BIGINT] ELSE [192 + unicode(ch)::BIGINT // 64, 128 + unicode(ch)::BIGINT % 64] END))),
    lambda c, b: xor(c // 256, t[1 + xor(c % 256, b)]))) AS h FROM runs, crc),
words AS MATERIALIZED (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM (SELECT times, CASE WHEN h % 31 <> 0 THEN run
    ELSE substr(run, 1, h % len(run)) || substr(run, h % len(run) + 2) END AS word FROM hashed) WHERE len(word) >= 7 GROUP BY word HAVING sum(times) >= 2),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, len(word) + 1)) AS i FROM words)),
near AS (SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION SELECT c.word, w.word, w.n FROM cut c JOIN words w ON w.word = c.rest
    UNION SELECT w.word, c.word, c.n FROM cut c JOIN words w ON w.word = c.rest),
best AS (SELECT word, count(*) AS n_near, max(n) AS most, arg_min(other, (-n, other)) AS other FROM near GROUP BY word),
forms AS MATERIALIZED (SELECT w.word, CASE WHEN most >= 10 * w.n THEN other END AS form, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 10 * w.n THEN most END AS form_n
    FROM words w LEFT JOIN best b ON b.word = w.word),
steps(word, root) AS (SELECT word, word FROM forms UNION ALL SELECT s.word, f.form FROM steps s JOIN forms f ON f.word = s.root WHERE f.form IS NOT NULL),
roots AS (SELECT s.word, s.root FROM steps s JOIN forms f ON f.word = s.root WHERE f.form IS NULL)
SELECT f.word, form, root, n, n_near, form_n FROM forms f JOIN roots r ON r.word = f.word
"""

QUERIES = {
    "op1_ngram_scores": (op1_ngram_scores, OP1_SQL),
    "op2_fingerprints": (op2_fingerprints, None),
    "op3_secrets": (op3_secrets, OP3_SQL),
    "op4_packing": (op4_packing, None),
    "op5_quality": (op5_quality, None),
    "op6_main_text": (op6_main_text, None),
    "op7_exact_dedup": (op7_exact_dedup, OP7_SQL),
    "op8_near_dedup": (op8_near_dedup, OP8_SQL),
    "op9_language_id": (op9_language_id, None),
    "op10_mixing": (op10_mixing, OP10_SQL),
    "op11_fill_middle": (op11_fill_middle, OP11_SQL),
    "op12_decontamination": (op12_decontamination, OP12_SQL),
    "op13_spelling": (op13_spelling, OP13_SQL),
}
