"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from borgata.llm import (
    decontaminate, licenses, line_dedup, lm_scoring, near_dups, pieces, quality_model, quality_rules, ranked_search, sharding,
    spelling, token_counts, vector_dups,
)

_ROOT = Path(__file__).resolve().parents[2]
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once per application; and, unless the session
    says otherwise, fewer rows per Arrow batch than the default, because rows are whole documents."""
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(batch) == "10000":
        spark.conf.set(batch, "1000")
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    path = Path(tempfile.mkdtemp(prefix="borgata-")) / "borgata.zip"
    with zipfile.ZipFile(path, "w") as z:
        for file in sorted((_ROOT / "borgata").rglob("*.py")):
            z.write(file, file.relative_to(_ROOT))
    context.addPyFile(str(path))
    _shipped.add(context.applicationId)


def shipped(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(fn)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        ship(spark)
        return fn(spark, sf)

    return run


QUERIES = {
    fn.__name__: shipped(fn)
    for fn in (
        licenses.op1_license_scan,
        sharding.op2_sharding,
        quality_model.op3_quality_model,
        near_dups.op4_near_dups,
        line_dedup.op5_line_dedup,
        quality_rules.op6_quality_rules,
        token_counts.op7_token_counts,
        decontaminate.op8_decontaminate,
        lm_scoring.op9_lm_scores,
        pieces.op10_pieces,
        vector_dups.op11_vector_dups,
        ranked_search.op12_ranked_search,
        spelling.op13_spelling,
    )
}

_FOLD = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

_LINE_DEDUP = f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, generate_subscripts(ls, 1) AS pos, unnest(ls) AS line FROM split),
keyed AS (SELECT *, trim({_FOLD.format('line')}, {_BLANKS}) AS k FROM lines),
owner AS (SELECT k, min(doc_id) AS owner FROM keyed WHERE length(k) >= {line_dedup.LEAST} GROUP BY k),
marked AS (SELECT doc_id, pos, line, coalesce(owner <> doc_id, false) AS gone FROM keyed LEFT JOIN owner USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
 sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

_TOKENS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_K = near_dups.SHINGLE
_NEAR_DUPS = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_TOKENS.format(_FOLD.format('text'))} AS w FROM documents),
placed AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {_K - 2}, 2))) AS i FROM d WHERE len(w) > 0),
sets AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + {_K - 1}], ' ') AS s FROM placed),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both_ FROM sets a JOIN sets b USING (s) WHERE a.doc_id < b.doc_id
 GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
 WHERE 100 * both_ >= {near_dups.LEAST_PERCENT} * (p.n + q.n - both_)),
sides AS (SELECT x AS a, y AS b FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, sides.b FROM reach JOIN sides ON reach.b = sides.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) LEFT JOIN sizes USING (doc_id)
"""

_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_DECONTAMINATE = f"""
WITH item AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS.format(_FOLD.format('text'))} AS w FROM benchmark),
sized AS (SELECT item, w, least(len(w), {decontaminate.WINDOW}) AS k FROM item WHERE len(w) > 0),
placed AS (SELECT item, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM sized),
wanted AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS win FROM placed),
doc AS (SELECT doc_id, {_WORDS.format(_FOLD.format('text'))} AS w FROM documents),
spots AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM doc, (SELECT DISTINCT k FROM wanted)),
hits AS (SELECT DISTINCT doc_id, i, k, item
 FROM (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS win FROM spots) JOIN wanted USING (k, win)),
covered AS (SELECT doc_id, count(*) AS n_hit
 FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS pos FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
 FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
 sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def _quality_sql() -> str:
    rules = quality_rules.RULES
    size = quality_rules.WINDOW
    values = ", ".join(f"('{r}', {rules[r][0].replace(' DIV ', ' // ')})" for r in rules)
    slack = " ".join(f"WHEN '{r}' THEN {rules[r][1]}" for r in rules)
    low = ", ".join(f"'{r}'" for r in rules if rules[r][2])
    return rf"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t,
 regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + {size - 1}], ' ') AS x
 FROM (SELECT doc_id, w, unnest(range(1, len(w) - {size - 2})) AS i FROM d)),
twice AS (SELECT doc_id, x FROM win GROUP BY doc_id, x HAVING count(*) > 1),
repeats AS (SELECT doc_id, count(*) AS n_repeat_words FROM (SELECT DISTINCT doc_id, unnest(range(i, i + {size})) AS pos
 FROM win JOIN twice USING (doc_id, x)) GROUP BY doc_id),
line AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d),
lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines
 FROM line WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
stutter AS (SELECT doc_id, count(*) FILTER (WHERE w[i] = w[i + 1]) AS n_stutters
 FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM d) GROUP BY doc_id),
c AS (SELECT doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words,
 CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
 CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, coalesce(n_lines, 0) AS n_lines,
 coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
 coalesce(n_stutters, 0) AS n_stutters
 FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN repeats USING (doc_id) LEFT JOIN stutter USING (doc_id)),
v AS (SELECT doc_id, lang, source, rule, CAST(value AS BIGINT) AS value
 FROM c, LATERAL (SELECT * FROM (VALUES {values}) AS x(rule, value)) WHERE n_words > 0),
sketch AS (SELECT lang, source, rule, value - value % (CAST(1 AS BIGINT) << greatest(length(bin(value)) - 8, 0)) AS bucket,
 count(*) AS n FROM v GROUP BY ALL),
shared AS (SELECT lang, rule, bucket, sum(n) AS l FROM sketch GROUP BY ALL),
both_ AS (SELECT lang, source, rule, bucket, sum(n) AS n, sum(l) AS l FROM (
 SELECT lang, source, rule, bucket, n, 0 AS l FROM sketch UNION ALL
 SELECT g.lang, g.source, s.rule, s.bucket, 0, s.l FROM (SELECT DISTINCT lang, source FROM sketch) g
 JOIN shared s ON g.lang IS NOT DISTINCT FROM s.lang) GROUP BY ALL),
weighted AS (SELECT *, n * sum(l) OVER g + l * sum(n) OVER g AS weight FROM both_
 WINDOW g AS (PARTITION BY lang, source, rule)),
ranked AS (SELECT *, sum(weight) OVER (g ORDER BY bucket ROWS UNBOUNDED PRECEDING) AS below, sum(weight) OVER g AS total,
 sum(l) OVER (g ORDER BY bucket ROWS UNBOUNDED PRECEDING) AS l_below, sum(l) OVER g AS l_total
 FROM weighted WINDOW g AS (PARTITION BY lang, source, rule)),
quarters AS (SELECT lang, source, rule, min(bucket) FILTER (WHERE 4 * below >= total) AS q1,
 min(bucket) FILTER (WHERE 4 * below >= 3 * total) AS q3, min(bucket) FILTER (WHERE 4 * l_below >= l_total) AS l1,
 min(bucket) FILTER (WHERE 4 * l_below >= 3 * l_total) AS l3 FROM ranked GROUP BY ALL),
fence AS (SELECT *, greatest({quality_rules.STRETCH} * (q3 - q1), CASE rule {slack} END) AS reach,
 greatest({quality_rules.STRETCH} * (l3 - l1), CASE rule {slack} END) AS l_reach FROM quarters),
outside AS (SELECT DISTINCT doc_id FROM v JOIN fence f ON v.rule = f.rule AND v.lang IS NOT DISTINCT FROM f.lang
 AND v.source IS NOT DISTINCT FROM f.source WHERE value > least(q3 + reach, l3 + 2 * l_reach)
 OR (v.rule IN ({low}) AND value < greatest(q1 - reach, l1 - 2 * l_reach))),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
 NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM outside) AS kept
FROM judged
"""

_VECTOR_DUPS = f"""
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
good AS (SELECT * FROM v WHERE vec_id IS NOT NULL AND len(e) > 0 AND list_count(e) = len(e)
 AND len(list_filter(e, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.r AS x, b.r AS y FROM good a JOIN good b ON a.r <> b.r AND len(a.e) = len(b.e)
 WHERE list_cosine_similarity(a.e, b.e) >= {vector_dups.LEAST}),
reach AS (SELECT r AS x, r AS y FROM v UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
counts AS (SELECT x, count(*) AS n FROM links GROUP BY x),
least AS (SELECT reach.x, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.y GROUP BY reach.x)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, coalesce(vec_id = component_id, true) AS kept
FROM v JOIN least ON least.x = r LEFT JOIN counts ON counts.x = r
"""

_TERMS = r"regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
_LOWER_TERM = "translate(unnest({}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term"
_RANKED_SEARCH = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS t FROM documents),
sized AS (SELECT r, doc_id, len(t) AS n, t FROM d WHERE len(t) > 0),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS l FROM sized),
tf AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, n, {_LOWER_TERM.format('t')} FROM sized) GROUP BY ALL),
df AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY term, docs),
q AS (SELECT DISTINCT item_id, {_LOWER_TERM.format(_TERMS)} FROM benchmark),
scored AS (SELECT item_id, r, doc_id,
 CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // l)))) AS BIGINT) AS score
 FROM tf JOIN q USING (term) JOIN df USING (term), total GROUP BY item_id, r, doc_id),
ranked AS (SELECT item_id, doc_id, score,
 CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank
 FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {ranked_search.BEST}
"""


ORACLES = {
    "op4_near_dups": _NEAR_DUPS,
    "op5_line_dedup": _LINE_DEDUP,
    "op6_quality_rules": _quality_sql(),
    "op8_decontaminate": _DECONTAMINATE,
    "op11_vector_dups": _VECTOR_DUPS,
    "op12_ranked_search": _RANKED_SEARCH,
}
