"""The operators as queries over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import chat_windows, cover_tree, importance, language_id, lattice, lexical_search, licenses, packing, quality_rules, rule_ensemble, sentence_pieces, simhash, token_codes
from .common import read_table

#: A conversation that holds the template's own kind of control strings.
ODD_TEXT = "\\### Assistant: </turn> ok"


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(read_table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(read_table(spark, sf_dir, "documents"), words=4, radius=4)


def op3_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(read_table(spark, sf_dir, "documents"))


def op4_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_codes.new_path(spark)
    token_codes.write_codes(read_table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), drops_space=True)
    return token_codes.documents_of(token_codes.open_codes(spark, path))


def op5_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.lattice_groups(read_table(spark, sf_dir, "embeddings"), least=0.93)


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(read_table(spark, sf_dir, "documents"))


def op7_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_ensemble.quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op8_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.piece_digests(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), size=1024)


def op10_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.createDataFrame([(-7, 0, "user", ODD_TEXT), (-7, 1, "assistant", ODD_TEXT)], rows.schema)
    return chat_windows.chat_digests(rows.unionByName(odd))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), k=10)


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op13_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.top_k(read_table(spark, sf_dir, "embeddings"), k=5)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_quality_rules, op2_simhash, op3_language_mixture, op4_token_codes, op5_lattice, op6_licenses, op7_rule_ensemble, op8_sentence_pieces, op9_packing, op10_chat_windows, op11_lexical_search, op12_resampling, op13_cover_tree)
}
#: Length of a text once it is escaped.
_ESCAPED = r"(2 * length({0}) - length(regexp_replace({0}, '[\\\\#<:]', '', 'g')))"
#: Words of a text in lower case.
_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce({0}, ''), '" + licenses.UPPER + "', '" + licenses.LOWER + r"'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
_TEMPLATES = ", ".join(f"({i}, '{label}', '{text.replace(chr(39), chr(39) * 2)}', {phrase})" for i, (label, text, phrase) in enumerate([*((label, text, False) for label, text in licenses.TEMPLATES), *((label, text, True) for text, label in licenses.PHRASES.items())]))
#: Terms of a text, in lower case.
_TERMS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '" + licenses.UPPER + "', '" + licenses.LOWER + r"'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda w: w <> '')"
ORACLE_SQL: dict[str, str] = {
    "op11_lexical_search": f"""WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, {_TERMS} AS w FROM documents),
 sized AS (SELECT row_id, doc_id, len(w) AS n, w FROM d WHERE len(w) > 0),
 whole AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS total FROM sized),
 flat AS (SELECT row_id, unnest(w) AS term FROM sized),
 tf AS (SELECT row_id, term, count(*) AS tf FROM flat GROUP BY row_id, term),
 weighed AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS weight FROM tf, whole GROUP BY term),
 asked AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
 scored AS (SELECT item_id, tf.row_id, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // total)))) AS BIGINT) AS score
  FROM asked JOIN tf USING (term) JOIN weighed USING (term) JOIN sized USING (row_id), whole GROUP BY item_id, tf.row_id, doc_id),
 ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM scored WHERE score > 0)
 SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10""",
    "op6_licenses": f"""WITH listed(template, label, text, phrase) AS (VALUES {_TEMPLATES}),
 split AS (SELECT template, label, phrase, {_WORDS.format("text")} AS w FROM listed),
 sized AS (SELECT *, least(len(w), 3) AS k, len(w) - least(len(w), 3) + 1 AS grams FROM split),
 parts AS (SELECT *, unnest(range(grams)) AS pos FROM sized),
 grams AS (SELECT template, label, phrase, grams, k, pos, array_to_string(w[pos + 1 : pos + k], ' ') AS gram FROM parts),
 texts AS (SELECT row_number() OVER () AS row_id, doc_id, {_WORDS.format("text")} AS w FROM documents),
 flat AS (SELECT row_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS place FROM texts),
 rolled AS (SELECT row_id, place, word || ' ' || lead(word) OVER o AS two, word || ' ' || lead(word) OVER o || ' ' || lead(word, 2) OVER o AS three, word || ' ' || lead(word) OVER o || ' ' || lead(word, 3) OVER o AS late, word || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o AS early FROM flat WINDOW o AS (PARTITION BY row_id ORDER BY place)),
 hits AS (SELECT row_id, place, g.* FROM rolled JOIN grams g ON g.k = 3 AND g.gram = three UNION ALL SELECT row_id, place, g.* FROM rolled JOIN grams g ON g.k = 2 AND g.gram = two
  UNION ALL SELECT row_id, place, g.* FROM rolled JOIN grams g ON g.k = 3 AND NOT g.phrase AND g.grams <= 12 AND g.gram = late UNION ALL SELECT row_id, place, g.* FROM rolled JOIN grams g ON g.k = 3 AND NOT g.phrase AND g.grams <= 12 AND g.gram = early),
 cells AS (SELECT DISTINCT row_id, template, place - pos AS diagonal FROM hits WHERE NOT phrase),
 steps AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY row_id, template ORDER BY diagonal) <= 3 THEN 0 ELSE 1 END AS step FROM cells),
 grouped AS (SELECT *, sum(step) OVER (PARTITION BY row_id, template ORDER BY diagonal) AS grp FROM steps),
 spans AS (SELECT h.row_id, label, grams, count(DISTINCT pos) AS n, max(place) - min(place) + 1 AS width FROM hits h JOIN grouped g ON g.row_id = h.row_id AND g.template = h.template AND g.diagonal = h.place - h.pos WHERE NOT phrase GROUP BY h.row_id, h.template, label, grams, grp),
 named AS (SELECT row_id, label, n::DOUBLE / grams AS coverage FROM spans WHERE n::DOUBLE / grams >= CASE WHEN grams <= 12 THEN 1.0::DOUBLE ELSE 0.6::DOUBLE END AND width <= ceil(grams * 1.5::DOUBLE) + 3),
 own AS (SELECT row_id, list(label) AS labels, max(coverage) AS score FROM named GROUP BY row_id),
 base AS (SELECT row_id, list(label) AS labels, count(*) AS n, min(place) AS low, max(place) AS high FROM hits WHERE phrase GROUP BY row_id)
 SELECT doc_id, len(w) AS n_words, coalesce(base.n, 0) AS n_base, base.low AS first_word, base.high AS last_word, coalesce(array_to_string(list_sort(list_distinct(base.labels)), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(own.labels, [])))), ','), '') AS labels, CASE WHEN base.n > 0 THEN 1.0::DOUBLE ELSE coalesce(own.score, 0.0::DOUBLE) END AS score
 FROM texts LEFT JOIN base USING (row_id) LEFT JOIN own USING (row_id)""",
    "op13_cover_tree": """WITH v AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
 ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM scored)
 SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""",
    "op5_lattice": """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
 sound AS (SELECT * FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(e, lambda x: x * x)) > 0),
 links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93),
 reach AS (SELECT vec_id, vec_id AS r FROM v UNION SELECT reach.vec_id, links.b FROM reach JOIN links ON reach.r = links.a),
 n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
 SELECT vec_id, coalesce(max(n.n), 0) AS n_links, min(r) AS component_id, vec_id = min(r) AS kept FROM reach LEFT JOIN n ON n.a = vec_id GROUP BY vec_id""",
    # where a window that begins at each turn would end, by prefix sums; then the walk from window to window
    "op10_chat_windows": f"""WITH RECURSIVE said AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{ODD_TEXT}' UNION ALL SELECT -7, 1, 'assistant', '{ODD_TEXT}'),
 placed AS (SELECT *, row_number() OVER o AS nth, (length(text) + 3) // 4 + 4 AS cost, 14 + {_ESCAPED.format("role")} + {_ESCAPED.format("text")} AS size,
  first_value(role) OVER o = 'system' AS led FROM said WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
 summed AS (SELECT *, sum(cost) OVER o AS cost_to, sum(size) OVER o AS size_to, CASE WHEN led THEN first_value(cost) OVER o ELSE 0 END AS led_cost, CASE WHEN led THEN first_value(size) OVER o ELSE 0 END AS led_size,
  lag(cost, 1) OVER o AS cost_1, lag(cost, 2) OVER o AS cost_2, lag(size, 1) OVER o AS size_1, lag(size, 2) OVER o AS size_2 FROM placed WINDOW o AS (PARTITION BY conv_id ORDER BY nth)),
 headed AS (SELECT *, led AND nth > 1 AND (led_cost + cost <= 256 OR cost > 256) AS head FROM summed),
 opened AS (SELECT *, cost + CASE WHEN head THEN led_cost ELSE 0 END AS base, nth - CASE WHEN led THEN 2 ELSE 1 END AS free FROM headed),
 recalled AS (SELECT *, CASE WHEN led AND NOT head OR free < 1 OR base + cost_1 > 256 THEN 0 WHEN free < 2 OR base + cost_1 + cost_2 > 256 THEN 1 ELSE 2 END AS n FROM opened),
 windows AS (SELECT conv_id, nth, base + CASE WHEN n > 0 THEN cost_1 ELSE 0 END + CASE WHEN n > 1 THEN cost_2 ELSE 0 END AS used, cost_to AS upto,
  CASE WHEN head THEN led_size ELSE 0 END + CASE WHEN n > 0 THEN size_1 ELSE 0 END + CASE WHEN n > 1 THEN size_2 ELSE 0 END AS before FROM recalled),
 next AS (SELECT w.conv_id, w.nth, any_value(w.before) AS before, min(s.nth) AS following FROM windows w LEFT JOIN summed s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.nth > w.nth AND w.used + s.cost_to - w.upto > 256 GROUP BY w.conv_id, w.nth),
 walk AS (SELECT conv_id, nth, before, following FROM next WHERE nth = 1 UNION ALL SELECT n.conv_id, n.nth, n.before, n.following FROM walk JOIN next n ON n.conv_id IS NOT DISTINCT FROM walk.conv_id AND n.nth = walk.following),
 shown AS (SELECT conv_id, sum(before) AS repeated FROM walk GROUP BY conv_id),
 told AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY nth)) AS turns_sha256,
  length(coalesce(string_agg(text, '' ORDER BY nth) FILTER (role = 'assistant'), '')) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY nth) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(size) AS size FROM placed GROUP BY conv_id)
 SELECT told.conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, CAST(size + repeated AS BIGINT) AS formatted_chars FROM told JOIN shown ON told.conv_id IS NOT DISTINCT FROM shown.conv_id""",
}
