"""The registered queries of the corpus operators, with SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, convnet, divergence, filter_audit, idfiles, kneser_ney, language, licenses, mixing, multi_index, personal, rules, simhash
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(build):
        QUERIES[name] = build
        if sql:
            ORACLES[name] = sql
        return build

    return add


LONG = ", ".join(f"cast({c} AS bigint) AS {c}" for c in ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "failure_bits"])
BLANK = r"[\x20\x09-\x0D]"


@register("op1_quality_rules", rf"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
  m AS (SELECT doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, length(regexp_replace(t, '{BLANK}', '', 'g')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l,
    length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS n_letters FROM t),
  p AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM m),
  g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM p),
  r AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM g WHERE c > 1) GROUP BY doc_id),
  a AS (SELECT m.doc_id, len(w) AS n_words, word_chars, n_symbols, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, n_upper, n_letters FROM m LEFT JOIN r USING (doc_id)),
  b AS (SELECT *, {" + ".join(f"CASE WHEN {c} THEN {1 << k} ELSE 0 END" for k, c in enumerate(rules.RULES.values()))} AS failure_bits FROM a)
  SELECT doc_id, {LONG}, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, failure_bits = 0 AS kept FROM b""")
def _(spark, sf_dir):
    entries = rules.apply_policy(rules.apply_policy(rules.ledger(table(spark, sf_dir, "documents")), "base", "base_passed"))
    return entries.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "failure_bits",
                          (~F.col("base_passed")).alias("base_failed"), "kept")


@register("op2_quality_classifier")
def _(spark, sf_dir):
    return convnet.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op9_toxicity")
def _(spark, sf_dir):
    return kneser_ney.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op3_simhash_duplicates")
def _(spark, sf_dir):
    found = simhash.components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@register("op7_byte_bpe")
def _(spark, sf_dir):
    import public_tokenizers

    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@register("op6_id_files")
def _(spark, sf_dir):
    import public_tokenizers

    return idfiles.write_and_read(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@register("op4_license_scan")
def _(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


@register("op8_personal_data")
def _(spark, sf_dir):
    return personal.summary(table(spark, sf_dir, "documents"))


@register("op10_source_mixing", """WITH d AS (SELECT doc_id, source, coalesce('=' || source, '') AS src, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
    length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>!]', '', 'g')) AS symbols, (('0x' || substr(md5('mix' || coalesce(cast(doc_id AS string), '')), 1, 13))::BIGINT + 0.5::DOUBLE) / (1::BIGINT << 52)::DOUBLE AS draw FROM documents),
  k AS (SELECT *, -ln(draw) / greatest(0.1::DOUBLE, 1 - symbols::DOUBLE / greatest(size, 1)) AS key FROM d),
  s AS (SELECT src, cast(sum(size) AS bigint) AS source_size FROM k GROUP BY src),
  w AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][cast((row_number() OVER (ORDER BY src = '', src) - 1) % 3 + 1 AS int)] AS w, 2.0::DOUBLE * source_size AS cap FROM s),
  l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM w),
  t AS (SELECT src, source_size, least(cap, coalesce((SELECT max(level) FROM l WHERE level <= cap / w), 0) * w) AS target FROM l),
  e AS (SELECT *, CASE WHEN source_size > 0 THEN cast(floor(target / source_size) AS int) ELSE 0 END AS epochs FROM t),
  r AS (SELECT k.*, source_size, target, epochs, target - epochs * source_size AS rest, sum(size) OVER (PARTITION BY src ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) - size AS before FROM k JOIN e USING (src))
  SELECT doc_id, cast(size AS bigint) AS size, source_size, target, cast((epochs + CASE WHEN before + size / 2 <= rest THEN 1 ELSE 0 END) * size AS bigint) AS taken FROM r""")
def _(spark, sf_dir):
    return mixing.mixed_sizes(table(spark, sf_dir, "documents"))


@register("op5_nearest_vectors")
def _(spark, sf_dir):
    return multi_index.search(table(spark, sf_dir, "embeddings"))


@register("op12_language_id")
def _(spark, sf_dir):
    return language.classify(table(spark, sf_dir, "documents"))


@register("op13_filter_audit", r"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
  f AS (SELECT doc_id, part, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, t FROM d),
  b AS (SELECT doc_id, part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e FROM f),
  l AS (SELECT doc_id, max(coalesce(quality = 1, false)) AS good, max(coalesce(toxic = 1, false)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
  m AS (SELECT part, concat(if(a, 'A', ''), if(b, 'B', ''), if(c, 'C', ''), if(d, 'D', ''), if(e, 'E', '')) AS fails, coalesce(good, false) AS good,
    coalesce(toxic, false) AS toxic, count(*) AS n FROM b LEFT JOIN l USING (doc_id) GROUP BY ALL),
  x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
  o AS (SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM x p, x q, x r, x s, x t
    WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
  y AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM o),
  g AS (SELECT *, contains(fails, filter_order[step]) AS failing, fails <> '' AND regexp_matches(fails, '[' || filter_order[1:step - 1] || '-]') AS gone FROM y, m),
  h AS (SELECT part, filter_order, step, filter_order[step] AS x, coalesce(sum(n) FILTER (NOT failing AND NOT gone), 0) AS kept,
    coalesce(sum(n) FILTER (failing AND NOT gone), 0) AS removed, coalesce(sum(n) FILTER (failing AND gone), 0) AS redundant, coalesce(sum(n) FILTER (failing AND length(fails) = 1), 0) AS unique_fails,
    coalesce(sum(n) FILTER (failing AND NOT gone AND good), 0) AS good_lost, coalesce(sum(n) FILTER (failing AND NOT gone AND toxic), 0) AS toxic_lost FROM g GROUP BY part, filter_order, step)
  SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
    good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley FROM h""")
def _(spark, sf_dir):
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op11_source_divergence", r"""WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
  w AS (SELECT row, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
  v AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT row) >= 10),
  c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN v USING (lang, term) GROUP BY lang, source, term),
  k AS (SELECT lang, count(*) AS kinds FROM v GROUP BY lang),
  g AS (SELECT lang, source, coalesce(total, 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source) USING (lang, source)),
  p AS (SELECT g.lang, g.source, v.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (g.total + 2 * kinds) AS p
    FROM g JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term),
  l AS (SELECT c.lang, term, 1 + 1000000000::HUGEINT * (sum(n) + 2) // (any_value(t.total) + 2 * any_value(kinds)) AS q
    FROM c JOIN k USING (lang) JOIN (SELECT lang, sum(total) AS total FROM g GROUP BY lang) t USING (lang) GROUP BY c.lang, term),
  x AS (SELECT a.lang, a.source, b.source AS item, coalesce(f, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS f FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
      GROUP BY a.lang, a.source, b.source) s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
  y AS (SELECT lang, source, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM p JOIN l USING (lang, term) WHERE n > 0 AND p > q),
  r AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM x UNION ALL
    SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM y)
  SELECT * FROM r WHERE part = 'pair' OR rank <= 10""")
def _(spark, sf_dir):
    return divergence.audit(table(spark, sf_dir, "documents"))
