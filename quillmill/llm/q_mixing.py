"""Query op7_mixing: which documents stay so that tokens by source, language and topic meet their targets."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .mixing import OTHER, Targets, fit_mix, tokens_of, topic_of, uniform_of
from .shared import Scratch, table, text_or_empty

KEEP, ROUNDS = 0.5, 25
TARGETS = Targets(
    source={f"src{k}": 0.05 for k in range(20)},
    lang={"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15},
    topic={"prose": 0.8, "tables": 0.1, "symbols": 0.05, "short": 0.05},
)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = text_or_empty(docs["text"])
    rows = docs.select(
        "doc_id", "source", "lang", topic_of(text).alias("topic"), tokens_of(text).alias("n_tokens"), uniform_of(docs["doc_id"], text).alias("u")
    )
    rows = Scratch(spark, "mixing").save(rows, "rows")  # the texts are read once
    place = [F.col("source").cast("string"), F.col("lang").cast("string"), F.col("topic")]
    probability = fit_mix(rows, *place, F.col("n_tokens"), TARGETS, KEEP, ROUNDS).probability(*place)
    return rows.select(
        "doc_id", "source", "lang", "topic", "n_tokens", F.round(probability, 9).alias("probability"), (F.col("u") < probability).alias("kept")
    )


QUERIES = {"op7_mixing": op7_mixing}


def _values(target: dict[str, float]) -> str:
    return ", ".join(f"('{v}', {share!r}::DOUBLE)" for v, share in target.items())


def _oracle() -> str:
    """The same raking, each step a query over the cells; all targets here name no share for OTHER."""
    steps = []
    parts = {"s": TARGETS.source, "l": TARGETS.lang, "t": TARGETS.topic}
    for axis, target in parts.items():
        # the share of values that aren't named stays as it is, the named ones that occur share the rest
        steps.append(f"""
target_{axis}(v, share) AS (VALUES {_values(target)}),
present_{axis} AS (SELECT {axis} AS v, sum(tok) AS n FROM cells GROUP BY 1),
named_{axis} AS (SELECT p.v, p.n, CASE WHEN p.n > 0 THEN coalesce(g.share, 0) ELSE 0 END AS share FROM present_{axis} p LEFT JOIN target_{axis} g USING (v)),
kept_{axis} AS (SELECT coalesce(max(n) FILTER (v = '{OTHER}'), 0) / greatest(sum(n), 1e-300) AS kept, sum(share) AS total FROM named_{axis}),
raw_{axis} AS (SELECT v, CASE WHEN v = '{OTHER}' THEN CASE WHEN total > 0 THEN kept ELSE 1 END
                              WHEN total > 0 THEN share / total * (1 - kept) ELSE 0 END AS share FROM named_{axis}, kept_{axis}),
share_{axis} AS (SELECT v, share / greatest(sum(share) OVER (), 1e-300) AS share FROM raw_{axis})""")
    held = "w0"
    for k in range(ROUNDS):
        for axis in parts:
            after = f"w{k}_{axis}"
            steps.append(f"""
{after}_sum AS (SELECT *, sum(w) OVER (PARTITION BY {axis}) AS now FROM {held}),
{after} AS (SELECT r.s, r.l, r.t, r.tok, CASE WHEN r.now > 0 THEN r.w * (m.share / r.now) ELSE 0 END AS w
            FROM {after}_sum r JOIN share_{axis} m ON m.v = r.{axis})""")
            held = after

    def fold(column: str, target: dict[str, float]) -> str:
        named = ", ".join(f"'{v}'" for v in target)
        return f"CASE WHEN {column} IN ({named}) THEN {column} ELSE '{OTHER}' END"

    return f"""
WITH base AS (SELECT *, coalesce(text, '') AS x FROM documents),
docs AS (
  SELECT doc_id, source, lang, x, len(regexp_extract_all(x, '[^ \\n\\t\\r]+'))::BIGINT AS n_tokens,
         CASE WHEN (length(x) - length(translate(x, '%*#$&', ''))) * 20 > greatest(length(x), 1) THEN 'symbols'
              WHEN (length(x) - length(replace(x, '|', ''))) * 40 > greatest(length(x), 1) THEN 'tables'
              WHEN greatest(length(x), 1) < 600 THEN 'short' ELSE 'prose' END AS topic,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, md5(x))), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS u
  FROM base),
marked AS (SELECT *, {fold("source", TARGETS.source)} AS s, {fold("lang", TARGETS.lang)} AS l, {fold("topic", TARGETS.topic)} AS t FROM docs),
cells AS MATERIALIZED (SELECT s, l, t, sum(n_tokens)::DOUBLE AS tok FROM marked GROUP BY ALL),
w0 AS (SELECT s, l, t, tok, tok / greatest(sum(tok) OVER (), 1e-300) AS w FROM cells),{",".join(steps)},
chance AS MATERIALIZED (SELECT s, l, t, CASE WHEN tok > 0 THEN least(1.0, w * (SELECT sum(tok) FROM cells) * {KEEP}::DOUBLE / tok) ELSE 1.0 END AS p FROM {held})
SELECT doc_id, source, lang, topic, n_tokens, round(p, 9) AS probability, u < p AS kept
FROM marked JOIN chance USING (s, l, t)
"""


ORACLE_SQL = {"op7_mixing": _oracle()}
