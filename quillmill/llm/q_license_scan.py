"""Query op4_license_scan: license statements in all documents."""

from pyspark.sql import DataFrame, SparkSession

from .license_scan import BASE, TEMPLATES, scan
from .shared import table

LEAST_SCORE = 0.6


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), least_score=LEAST_SCORE).drop("places")


QUERIES = {"op4_license_scan": op4_license_scan}


def _list(words: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _oracle() -> str:
    """Every word position of every text against every template: the key phrase in place, then the weighted share."""
    templates = ",\n".join(
        f"({k}, '{t.label}', {_list(t.words)}, {t.key}, {t.length}, {str(t.exact).lower()})" for k, t in enumerate((*BASE, *TEMPLATES))
    )
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
t(template, label, statement, key, length, exact) AS (VALUES {templates}),
vocabulary AS (SELECT DISTINCT unnest(statement) AS word FROM t),
seen AS (SELECT word, count(*) AS n FROM (SELECT unnest(list_distinct(words)) AS word FROM d) WHERE word IN (SELECT word FROM vocabulary) GROUP BY 1),
idf AS (SELECT v.word, ln(((SELECT count(*) FROM d) + 1)::DOUBLE / (coalesce(s.n, 0) + 1)) + 1e-3 AS w FROM vocabulary v LEFT JOIN seen s USING (word)),
flat AS (SELECT rid, words, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS position FROM d),
keyed AS (SELECT f.rid, f.words, f.position - t.key AS start, t.* FROM flat f JOIN t ON f.word = t.statement[t.key + 1]
          WHERE list_slice(f.words, f.position + 1, f.position + t.length) = list_slice(t.statement, t.key + 1, t.key + t.length)),
parts AS (SELECT rid, template, start, label, exact, unnest(statement) AS word, generate_subscripts(statement, 1) - 1 AS j, words FROM keyed),
shares AS (SELECT rid, template, start, any_value(label) AS label, any_value(exact) AS exact,
             sum(CASE WHEN start + j >= 0 AND words[start + j + 1] = p.word THEN w ELSE 0 END) / sum(w) AS share
           FROM parts p JOIN idf USING (word) GROUP BY rid, template, start),
placed AS (SELECT *, CASE WHEN exact THEN 1.0 ELSE round(share, 6) END AS score FROM shares),
good AS (SELECT * FROM placed WHERE exact OR score >= {LEAST_SCORE}),
found AS (SELECT rid, count(*) FILTER (exact) AS n_base, min(start) FILTER (exact) AS first_word, max(start) FILTER (exact) AS last_word,
            coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (exact), '') AS base_labels,
            string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score)::DOUBLE AS score FROM good GROUP BY rid)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
       last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN found USING (rid)
"""


ORACLE_SQL = {"op4_license_scan": _oracle()}
